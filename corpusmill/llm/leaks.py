"""Problem 9: passages of held-out items in documents.

Method: every window of ``width`` consecutive words (the size of the passages asked for) has the 64-bit SimHash of its
words, rolled along the text as running sums of their bits. The items' fingerprints stand in a multi-index of Hamming
blocks: the 64 bits are cut into ``radius`` + 1 blocks, so two fingerprints that differ in at most ``radius`` bits agree in
one block at least, and every such pair is met. Each candidate is then compared by the exact weighted similarity of its
word shingles; windows that are equal word by word are the leaks of p9_found (equal windows have equal fingerprints, so
none is lost).
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are hashed so many at once, whatever the length of a text; items are held by a worker so many at once.
BLOCK = 50_000
ITEMS = 20_000
SHINGLE, SIMILAR = 5, 0.8
_MARKUP = re.compile(r"</?[A-Za-z|!][^<>]{0,200}>")
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|[nrtbf\"/\\])")


@lru_cache(maxsize=1)
def _word():
    import regex

    return regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """The runs of letters and digits, case folded. Compatibility forms are unified; marks and invisible format
    characters (soft hyphens, joiners) do not end a word."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if c.isalnum() or unicodedata.category(c) not in ("Cf", "Mn"))
    return _word().findall(text.casefold())


def readings(text: str | None) -> list[list[str]]:
    """The words of a text as it stands and, where they differ, without its tags, entities and JSON escapes."""
    if not text:
        return []
    out = [words(text)]
    if "<" in text or "&" in text or "\\" in text:
        def plain(m):
            return chr(int(m[0][2:], 16)) if m[0][1] == "u" else " "

        bare = words(html.unescape(_MARKUP.sub(" ", _ESCAPE.sub(plain, text))).encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
        if bare != out[0]:
            out.append(bare)
    return out


def simhashes(ws: list[str], width: int) -> np.ndarray:
    """SimHash of each window of ``width`` words, in order."""
    number: dict[str, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in ws), dtype=np.int64, count=len(ws))
    if len(ws) < width:
        return np.empty(0, dtype=np.uint64)
    bits = np.frombuffer(b"".join(blake2b(w.encode("utf-8", "replace"), digest_size=8).digest() for w in number), dtype=np.uint8).reshape(-1, 8)
    signs = np.unpackbits(bits, axis=1).astype(np.int32) * 2 - 1
    sums = np.zeros((len(ws) + 1, 64), dtype=np.int32)
    np.cumsum(signs[at], axis=0, out=sums[1:])
    return np.packbits(sums[width:] - sums[:-width] > 0, axis=1).view(np.uint64).ravel()


class Index:
    """Multi-index of the fingerprints of all windows of the items."""

    def __init__(self, items: tuple[tuple[str, str], ...], width: int, radius: int):
        where: dict[tuple[str, ...], set[str]] = {}
        for item, text in items:
            for ws in readings(text):
                for i in range(len(ws) - width + 1):
                    where.setdefault(tuple(ws[i : i + width]), set()).add(item)
        self.width, self.radius = width, radius
        self.windows = list(where)
        self.items = [sorted(x) for x in where.values()]
        flat = [w for ws in self.windows for w in ws]
        self.marks = simhashes(flat, width)[::width] if flat else np.empty(0, dtype=np.uint64)
        seen: dict[str, int] = {}
        for ws in self.windows:
            for w in set(ws):
                seen[w] = seen.get(w, 0) + 1
        self.weight = {w: float(np.log1p(len(self.windows) / n)) for w, n in seen.items()}
        self.bits = 64 // (radius + 1)
        self.blocks = []
        for k in range(radius + 1):
            key = self._key(self.marks, k)
            order = np.argsort(key, kind="stable")
            self.blocks.append((order, np.searchsorted(key[order], np.arange(2**self.bits + 1)) if self.bits <= 20 else key[order]))

    def _key(self, marks: np.ndarray, k: int) -> np.ndarray:
        return ((marks >> np.uint64(k * self.bits)) & np.uint64(2**self.bits - 1)).astype(np.int64)

    def near(self, marks: np.ndarray) -> np.ndarray:
        """(number of a mark, number of an item's window) of every pair within the radius, once each."""
        out = [np.empty((0, 2), dtype=np.int64)]
        for k, (order, start) in enumerate(self.blocks):
            key = self._key(marks, k)
            if self.bits <= 20:
                low, high = start[key], start[key + 1]
            else:
                low, high = np.searchsorted(start, key), np.searchsorted(start, key, side="right")
            n = high - low
            i = np.repeat(np.arange(len(marks)), n)
            j = order[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(i) else i
            close = np.bitwise_count(marks[i] ^ self.marks[j]) <= self.radius
            out.append(np.stack([i[close], j[close]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def similarity(self, a: tuple[str, ...], b: tuple[str, ...]) -> float:
        """Weighted Jaccard of the word shingles; a shingle weighs what its words do, rare words more."""
        if a == b:
            return 1.0
        of = lambda ws: {ws[i : i + SHINGLE] for i in range(len(ws) - SHINGLE + 1)}
        x, y = of(a), of(b)
        heavy = lambda z: sum(sum(self.weight.get(w, 1.0) for w in t) for t in z)
        return heavy(x & y) / max(heavy(x | y), 1e-9)


@lru_cache(maxsize=2)
def _index(items: tuple[tuple[str, str], ...], width: int, radius: int) -> Index:
    return Index(items, width, radius)


def _search(texts: list[list[str]], index: Index) -> dict[tuple[int, str], float]:
    """(number of the text, item id) -> similarity of the best window, at least SIMILAR."""
    found: dict[tuple[int, str], float] = {}
    width = index.width

    def run(ws: list[str], owner: list[int]) -> None:
        for i, j in index.near(simhashes(ws, width)).tolist():
            if owner[i] != owner[i + width - 1]:
                continue
            s = index.similarity(tuple(ws[i : i + width]), index.windows[j])
            if s >= SIMILAR:
                for item in index.items[j]:
                    found[owner[i], item] = max(s, found.get((owner[i], item), 0.0))

    ws: list[str] = []
    owner: list[int] = []
    for n, text in enumerate(texts):
        for at in range(0, len(text), BLOCK):
            part = text[max(0, at - width + 1) : at + BLOCK]
            # A text's blocks overlap; they are searched apart, so that no window spans two blocks' copies.
            if ws and at:
                run(ws, owner)
                ws, owner = [], []
            ws += part
            owner += [n] * len(part)
            if len(ws) >= BLOCK:
                run(ws, owner)
                ws, owner = [], []
    run(ws, owner)
    return found


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", width: int = 12, radius: int = 3) -> DataFrame:
    """doc_id, item_id, similarity: the document has a window of ``width`` words within ``radius`` bits of one of the
    item's, whose shingles are similar (SIMILAR or more; 1 means ``width`` consecutive words of the item in order).

    items: a suite of tests, sent to the workers in blocks of ITEMS rows at most, one narrow pass over the documents a
    block. Items of fewer than ``width`` words, null and empty texts give nothing; repeated documents and items once each.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    named = items.where("text is not null").select(F.col(item_id).cast("string").alias("i"), "text")
    parts = max(1, -(-named.count() // ITEMS))
    out = None
    for part in range(parts):
        suite = tuple((r[0], r[1]) for r in named.where(F.pmod(F.xxhash64("i", "text"), F.lit(parts)) == part).collect())

        def run(batches, suite=suite):
            import pyarrow as pa

            index = _index(suite, width, radius)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    rows = batch.slice(at, 256)
                    texts, owner = [], []
                    for n, t in enumerate(rows.column(1).to_pylist()):
                        for ws in readings(t):
                            texts.append(ws)
                            owner.append(n)
                    best: dict[tuple[int, str], float] = {}
                    for (k, item), s in _search(texts, index).items():
                        best[owner[k], item] = max(s, best.get((owner[k], item), 0.0))
                    hits = sorted(best.items())
                    ids = rows.column(0).take(pa.array([n for (n, _), _ in hits], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([i for (_, i), _ in hits], pa.string()), pa.array([s for _, s in hits], pa.float64())], names=[doc_id, item_id, "similarity"])

        got = docs.where("text is not null").select(doc_id, "text").mapInArrow(run, f"`{doc_id}` {kind}, `{item_id}` string, similarity double")
        out = got if out is None else out.unionByName(got)
    return out.groupBy(doc_id, item_id).agg(F.max("similarity").alias("similarity"))
