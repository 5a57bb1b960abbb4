"""Problem 6: prompts that stand in train and, exactly or almost, in val or test of the same split version.

Method: content-defined chunks. A prompt's words are cut after every word whose own hash says so, and at the end of every
labelled part. An edited word damages two chunks at most, so of two prompts within ``edits`` edits each has at most
2 x edits chunks the other lacks, and among the 2 x edits + 1 rarest of either (in one order for all) there is one in
common. Pairs that share such a chunk, and whose signatures of words differ in few bits, are compared word by word.
Prompts of too few chunks are met by their rarest words in the same way. Each pair gets the overlap fraction: the summed
length of the chunks both have over that of all chunks of the held-out one.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.ledger import closed_pattern, labelled_pattern, learn_labels
from corpusmill.session import staged

EDITS = 4
#: Words of an edited prompt that formatting may have split or joined besides; each costs a chunk and four bits.
SPARE = 3


@lru_cache(maxsize=4)
def _patterns(labels: tuple[str, ...]):
    import regex

    asian = r"[\p{Han}\p{Hiragana}\p{Katakana}]"
    return regex.compile(r"[\p{L}\p{N}]"), regex.compile(labelled_pattern(labels)), regex.compile(closed_pattern(labels)), regex.compile(asian + r"|[\p{L}\p{N}--" + asian + "]+", regex.V1)


def _parts(text: str | None, labels: tuple[str, ...] = ()) -> tuple[list[list[str]], list[str]]:
    """(words of each labelled opening part, words of the rest), as ledger.canonical_prompt takes them apart."""
    some, known, closed, word = _patterns(labels)
    parts = [p for p in re.split(r"[\n\r|\u2028\u0085]+", (text or "").upper().lower()) if some.search(p)]
    n = 0
    while n < len(parts) - 1 and known.search(parts[n]):
        n += 1
    if n and n == len(parts) - 1 and closed.search(parts[n]):
        n += 1
    split = [word.findall(p) for p in parts]
    return sorted(split[:n]), [w for p in split[n:] for w in p]


@lru_cache(maxsize=1 << 16)
def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def _chunks(heads: list[list[str]], body: list[str]) -> dict[int, int]:
    """Digest of each chunk and its length."""
    out = {}
    for part in (*heads, body):
        held = ""
        for i, w in enumerate(part):
            held += w
            if i + 1 == len(part) or _hash(w) % 2 == 0:
                out[_hash(held) << 16 ^ len(held)] = len(held)
                held = ""
    return out


def overlap_of(a: str | None, b: str | None, labels: tuple[str, ...] = ()) -> float:
    """Length of the chunks of a that b has too over that of all its chunks; 0 if it has none."""
    x, y = _prepared(a, labels)[3], _prepared(b, labels)[3]
    return sum(n for c, n in x.items() if c in y) / max(sum(x.values()), 1)


def _tokens(heads: list[list[str]], body: list[str], edits: int) -> list[tuple[int, int]]:
    """(kind, hash): chunks (0), for short prompts words (1) and, for the shortest, one mark in common (2); and one for
    the whole prompt (3), by which those that differ in formatting only meet however their words are split."""
    chunks, words = set(), set()
    for part in (*heads, body):
        held = ""
        for i, w in enumerate(part):
            h = _hash(w)
            words.add(h)
            held += w
            if i + 1 == len(part) or h % 2 == 0:
                chunks.add(_hash(held) << 16 ^ len(held))
                held = ""
    out = [(0, c) for c in chunks]
    if len(chunks) <= 2 * edits:
        out += [(1, w) for w in words]
        if len(words) <= edits:
            out.append((2, 0))
    out.append((3, _hash("|".join(sorted("".join(p) for p in heads)) + "||" + "".join(body))))
    return out


def _signature(heads: list[list[str]], body: list[str]) -> list[int]:
    """256 bits, one set for each word: an edited word changes two of them at most."""
    bits = 0
    for part in (*heads, body):
        for w in part:
            bits |= 1 << _hash(w[::-1]) % 256
    return [(bits >> 64 * k & 2**64 - 1) - 2**63 for k in range(4)]


def plain_distance(a: list[str], b: list[str], most: int) -> int:
    """Words inserted, dropped or replaced, counted up to most + 1: furthest reaching points, diagonal by diagonal."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    reach: dict[int, int] = {}
    for e in range(most + 1):
        now = {}
        for k in range(-e, e + 1):
            # Replaced, dropped from a, inserted from b.
            i = 0 if e == 0 else min(max(reach.get(k, -9) + 1, reach.get(k - 1, -9) + 1, reach.get(k + 1, -9)), n, m + k)
            j = i - k
            if i < 0 or j < 0:
                continue
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            if i == n and j == m:
                return e
            now[k] = i
        reach = now
    return most + 1


def distance(a: list[str], b: list[str], most: int) -> int:
    """Words inserted, dropped or replaced between a and b, counted up to most + 1. Words that are only split or
    joined otherwise cost nothing."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if "".join(a) == "".join(b):
        return 0
    # Rows by words of a; split and joined words shift the band by as many words as they have parts.
    band, far = most + 4, most + 1
    rows: list[dict[int, int]] = []
    for i in range(len(a) + 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - band), min(len(b), i + band) + 1):
            if i == j == 0:
                row[0] = 0
                continue
            best = far
            if i:
                best = min(best, rows[i - 1].get(j, far) + 1)
            if j:
                best = min(best, row.get(j - 1, far) + 1)
            if i and j:
                best = min(best, rows[i - 1].get(j - 1, far) + (a[i - 1] != b[j - 1]))
                for k in (2, 3):
                    if i >= k and "".join(a[i - k : i]) == b[j - 1]:
                        best = min(best, rows[i - k].get(j - 1, far))
                    if j >= k and "".join(b[j - k : j]) == a[i - 1]:
                        best = min(best, rows[i - 1].get(j - k, far))
            row[j] = best
        rows.append(row)
        if min(row.values(), default=far) >= far and i > 3 and all(min(r.values(), default=far) >= far for r in rows[-3:]):
            return far
    return rows[len(a)].get(len(b), far)


@lru_cache(maxsize=4096)
def _prepared(text: str | None, labels: tuple[str, ...]) -> tuple[list[list[str]], list[str], list[str], dict[int, int]]:
    """Labelled parts, rest, all words in order, chunks: a prompt is in many pairs, one after another."""
    heads, body = _parts(text, labels)
    return heads, body, [w for p in heads for w in p] + body, _chunks(heads, body)


def within(a: str | None, b: str | None, most: int = EDITS, labels: tuple[str, ...] = ()) -> bool:
    """Whether two prompts are at most so many words apart: the plain distance first, which most such pairs keep."""
    return plain_distance(_prepared(a, labels)[2], _prepared(b, labels)[2], most) <= most or apart(a, b, most, labels) <= most


def apart(a: str | None, b: str | None, most: int = EDITS, labels: tuple[str, ...] = ()) -> int:
    """Words in which two prompts differ, formatting and the order of labelled parts aside, up to most + 1."""
    (ha, ba, *_), (hb, bb, *_) = _prepared(a, labels), _prepared(b, labels)
    ha, hb = list(ha), list(hb)
    whole = distance([w for p in ha for w in p] + ba, [w for p in hb for w in p] + bb, most)
    if whole == 0:
        return 0
    rest = distance(ba, bb, most)
    if rest > most:
        return whole
    for p in list(ha):
        twin = next((q for q in hb if "".join(q) == "".join(p)), None)
        if twin is not None:
            ha.remove(p)
            hb.remove(twin)
    if len(ha) < len(hb):
        ha, hb = hb, ha
    if len(ha) > most:  # each unmatched part differs in a word at least
        return min(whole, most + 1)
    hb = hb + [[]] * (len(ha) - len(hb))
    heads = min((sum(distance(p, q, most) for p, q in zip(ha, order)) for order in permutations(hb)), default=0)
    return min(whole, rest + heads, most + 1)


def _path(c: Column) -> Column:
    """A path in one spelling: single forward slashes, no "." steps, no outer white space."""
    t = F.regexp_replace(F.trim(c), r"[\\/]+", "/")
    return F.regexp_replace(F.regexp_replace(t, r"/(\./)+", "/"), r"^(\./)+", "")


def crossing(data: DataFrame, lines: DataFrame, manifest: DataFrame, edits: int = EDITS, labels: tuple[str, ...] | None = None) -> DataFrame:
    """id_a, id_b (the smaller first), split_version, split (val or test), held_id, train_id and overlap: every pair of records
    of which one is in train and the other in val or test of one version and whose prompts differ in ``edits`` words
    at most. Prompts without a letter or digit are compared with nothing; repeated lines count once."""
    labels = learn_labels(data) if labels is None else labels
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), _path(F.col(f"outputs.{s}_path")).alias("path")) for s in ("train", "val", "test"))))
    paths = manifest.select("split_version", sides.alias("s")).select("split_version", "s.*")
    member = lines.select(_path(F.col("split_path")).alias("path"), F.col("record_id").alias("id")).join(F.broadcast(paths), "path").select("split_version", "split", "id").distinct()
    member = staged(member, "member")

    def signed(batches):
        import pyarrow as pa

        for batch in batches:
            parts = [_parts(t, labels) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_signature(*p) for p in parts], pa.list_(pa.int64())), pa.array([_tokens(*p, edits) for p in parts], pa.list_(pa.struct([("kind", pa.int32()), ("mark", pa.int64())])))], names=["n", "id", "prompt", "s", "t"])

    prompts = data.select("id", "prompt").where(F.col("prompt").rlike(r"[\p{L}\p{N}]")).join(member.select("id").distinct(), "id", "left_semi")
    prompts = prompts.select(F.monotonically_increasing_id().alias("n"), "id", "prompt")
    prompts = staged(prompts.mapInArrow(signed, "n long, id string, prompt string, s array<long>, t array<struct<kind int, mark long>>"), "prompts")
    marks = prompts.select("n", F.explode("t").alias("t")).select("n", "t.*")
    # A chunk that only one prompt has meets nothing, but takes its place among the rarest.
    seen = marks.groupBy("kind", "mark").agg(F.count("*").alias("c"))
    marks = marks.join(seen, ["kind", "mark"])
    most = lambda k, m: F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("c", "kind", "mark")))), 1, m)
    rare = marks.groupBy("n").agg(F.concat(most(0, 2 * edits + 1 + SPARE), most(1, edits + 1), most(2, 1), most(3, 1)).alias("t"))
    rare = rare.select("n", F.explode("t").alias("t")).where("t.c > 1").select("n", "t.kind", "t.mark")
    sides = member.join(prompts.select("id", "n", "s"), "id").select("split_version", "split", "n", "s")
    rare = staged(rare.join(sides, "n"), "rare")
    one = lambda side, p: rare.where(side).select("split_version", "kind", "mark", F.col("split").alias(f"{p}_split"), F.col("n").alias(f"{p}_n"), F.col("s").alias(f"{p}_s"))
    flips = sum((F.bit_count(F.col("h_s")[k].bitwiseXOR(F.col("t_s")[k])) for k in range(4)), F.lit(0))
    met = one("split <> 'train'", "h").join(one("split = 'train'", "t"), ["split_version", "kind", "mark"])
    met = met.where("h_n <> t_n").where((F.col("kind") == 3) | (flips <= 2 * edits + 4 * SPARE)).select("split_version", F.col("h_split").alias("split"), "h_n", "t_n").distinct()
    texts = lambda p, name: prompts.select(F.col("n").alias(f"{p}_n"), F.col("id").alias(f"{name}_id"), F.col("prompt").alias(f"{name}_prompt"))
    both = met.join(texts("h", "held"), "h_n").join(texts("t", "train"), "t_n").select("split_version", "split", "held_id", "train_id", "held_prompt", "train_prompt")

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            texts = list(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()))
            ok = [within(a, b, edits, labels) for a, b in texts]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            shared = pa.array([overlap_of(a, b, labels) for (a, b), x in zip(texts, ok) if x], pa.float64())
            yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(4)), shared], names=["split_version", "split", "held_id", "train_id", "overlap"])

    near = both.mapInArrow(compare, "split_version string, split string, held_id string, train_id string, overlap double")
    return near.select(F.least("held_id", "train_id").alias("id_a"), F.greatest("held_id", "train_id").alias("id_b"), "split_version", "split", "held_id", "train_id", "overlap")
