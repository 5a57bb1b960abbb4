"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: a bounded-lookahead streaming transducer. A piece of pre-tokenised text is read byte by byte. For every prefix,
the last token of that prefix's encoding is known (the longest token whose neighbour on the left is the last token of the
rest and that the merge list would keep beside it); so the encodings of all prefixes form a tree of back pointers. A token is emitted once every prefix that
a later token can still lean on (those within the lookahead) agrees on it. The lookahead is computed from the merge list:
the length of its longest token, since no token ending after position i begins before i - longest + 1. Memory is a
window of that many positions plus the tokens not yet agreed on, whatever the length of the text. Decoding is an
incremental byte-to-text state machine.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter everywhere.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-tokenisation pattern the byte_bpe_50k files were made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encodings of so many short pieces are kept by a worker; the table is emptied when full, so memory stays bounded.
KEPT, SHORT = 200_000, 64


class Transducer:
    """Streaming encoder and decoder of one merge list."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {i: t for t, i in self.rank.items()}
        self.lookahead = max(map(len, self.rank))
        ends: dict[bytes, set[int]] = {}
        for t in self.rank:
            ends.setdefault(t[-2:], set()).add(len(t))
        self._lengths = {e: sorted(ls, reverse=True) for e, ls in ends.items()}  # of the tokens with these last bytes
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fit: dict[tuple[int, int], bool] = {}
        self._kept: dict[str, tuple[int, ...]] = {}

    def _merge(self, data: bytes) -> list[bytes]:
        """Plain merging of a short byte string, lowest rank first, leftmost among equals: the definition."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _whole(self, t: bytes) -> bool:
        """Whether the merge list ever makes this token of its own bytes (some entries are never reached)."""
        i = self.rank[t]
        known = self._parts.get(i, 0)
        if known == 0:
            known = self._parts[i] = (1, 1) if self._merge(t) == [t] else None
        return known is not None

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay apart when they meet: encoding them joined gives just these two."""
        key = (self.rank[left], self.rank[right])
        ok = self._fit.get(key)
        if ok is None:
            if len(self._fit) > 2 * KEPT:
                self._fit.clear()
            ok = self._fit[key] = self._merge(left + right) == [left, right]
        return ok

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one piece that arrives in chunks, each emitted as soon as it is stable."""
        window = bytearray()  # the bytes from position ``base`` on
        base = 0
        last: dict[int, bytes] = {}  # end position -> last token of that prefix's encoding
        emitted = 0  # the encoding is settled up to here
        n = 0
        for chunk in chunks:
            for byte in chunk:
                window.append(byte)
                n += 1
                tail = bytes(window[-2:])
                for k in (*self._lengths.get(tail, ()), 1) if len(tail) > 1 else (1,):
                    if k > n - emitted:
                        continue
                    t = bytes(window[n - k - base : n - base])
                    if t not in self.rank or not self._whole(t):
                        continue
                    if n - k == 0 or (n - k == emitted and emitted not in last) or (n - k in last and self.fits(last[n - k], t)):
                        last[n] = t
                        break
                if n - emitted > 2 * self.lookahead and n % self.lookahead == 0:
                    # Later tokens begin at or after n - lookahead + 1: what all prefixes from there on share is stable.
                    roots, settled = None, []
                    for end in range(n - self.lookahead + 1, n + 1):
                        if end not in last:
                            continue
                        chain, at = set(), end
                        while at > emitted:
                            chain.add(at)
                            at -= len(last[at])
                        roots = chain if roots is None else roots & chain
                    for end in sorted(e for e in roots or () if e <= n - self.lookahead):
                        settled.append(end)
                    at = emitted
                    for end in settled:
                        # consecutive settled ends lie on one chain
                        back, p = [], end
                        while p > at:
                            back.append(self.rank[last[p]])
                            p -= len(last[p])
                        yield from reversed(back)
                        at = end
                    if settled:
                        emitted = settled[-1]
                        for p in [p for p in last if p < emitted]:
                            del last[p]
                        del window[: emitted - self.lookahead - base if emitted - self.lookahead > base else 0]
                        base = max(base, emitted - self.lookahead)
        back, p = [], n
        while p > emitted:
            back.append(self.rank[last[p]])
            p -= len(last[p])
        yield from reversed(back)

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens, whose strings are ordinary text. Null and empty texts give []. A lone surrogate
        (no valid text) counts as a question mark."""
        if not text:
            return []
        out: list[int] = []
        kept = self._kept
        for m in _pattern().finditer(text):
            piece = m[0]
            ids = kept.get(piece)
            if ids is None:
                data = piece.encode("utf-8", "replace")
                if len(piece) > SHORT:
                    out.extend(self.stream(data[i : i + 4096] for i in range(0, len(data), 4096)))
                    continue
                ids = tuple(self.stream([data]))
                if len(kept) >= KEPT:
                    kept.clear()
                kept[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are complete; bytes that are no UTF-8 come out as U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := machine.decode(self.token[i]):
                yield text
        if text := machine.decode(b"", True):
            yield text


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encoded(df: DataFrame, id_col: str, text: Column, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """id_col, ids (array<int>). One narrow pass: each worker loads the vocabulary file (a path all workers can read)
    once. Null and empty texts give an empty list; repeated rows are encoded again; extra columns are ignored."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        t = transducer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = [t.encode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return df.select(F.col(id_col), text.alias("t")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded(df: DataFrame, id_col: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """id_col, text of (id_col, ids)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        t = transducer(vocabulary)
        for batch in batches:
            texts = ["".join(t.decode(x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")
