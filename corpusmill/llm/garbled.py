"""Problem 10: texts decoded with a wrong character encoding, wholly or in places.

Method: a multinomial classifier over hashed byte bigrams, trained on words of the corpus that were garbled here by every
chain of the list (written in one encoding and read in another, once or twice), predicts the exact chain of each word
that isn't plain ASCII. The chain is inverted, and the inversion counts only if it decodes strictly and gives words that
the classifier takes for whole; a chain that lost bytes can't be inverted, and needs more evidence instead.

A text is classified word by word, so garbled places in whole texts are found; words of one text that no evidence of their
own decides follow the chain of their neighbours when the text is restored. The classifier is fitted on the driver, on at
most ``WORDS`` distinct words of a language (chosen by hash; a documented bound); all texts are read whole in one narrow
pass, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import drop, staged

#: Words a script is learnt from, at most, and the buckets of the words' hashes they are chosen by.
WORDS = 2000
BITS = 15

#: What text is mistaken for. (written in, read in); the reader's undefined bytes become U+FFFD or, as many
#: programs do it, the control character of the same number. (Where UTF-8 or ASCII is what is read in by mistake, only
#: U+FFFD is left; that is a class of its own, "lost".)
CHAINS: tuple[tuple[str, ...], ...] = (
    *(("utf-8", r) for r in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866", "cp1253", "cp1254", "gbk", "cp932", "big5", "euc_kr")),
    ("utf-8", "cp1252", "utf-8", "cp1252"), ("utf-8", "latin-1", "utf-8", "latin-1"), ("utf-8", "cp1252", "utf-8", "cp1252", "utf-8", "cp1252"), ("utf-8", "cp1251", "utf-8", "cp1251"), ("utf-8", "mac_roman", "utf-8", "mac_roman"), ("utf-8", "cp437", "utf-8", "cp437"),
    *(("cp1251", r) for r in ("latin-1", "cp1252", "koi8_r", "cp866", "mac_cyrillic")),
    *(("koi8_r", r) for r in ("cp1251", "latin-1", "cp1252", "cp866")),
    *(("cp866", r) for r in ("cp1251", "latin-1", "cp1252", "koi8_r")),
    *(("cp1252", r) for r in ("cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "cp1250", "cp1253", "cp932", "gbk")),
    *(("mac_roman", r) for r in ("cp1252", "latin-1")),
    *(("cp437", r) for r in ("cp1252", "latin-1")),
    *(("cp932", r) for r in ("cp1252", "latin-1", "mac_roman", "euc_jp", "gbk")),
    *(("euc_jp", r) for r in ("cp1252", "latin-1", "mac_roman", "cp932", "gbk")),
)
#: Evidence (difference of log-probabilities) for a chain over whole text: with a strict inversion, without, and with one
#: to keep a word from being learnt as whole.
SURE, ALONE, SUSPECT = 7.0, 18.0, 3.0
#: Gain of fluency an inversion must bring; weight of the background of all classes; words a class needs to be learnt.
GAIN, MASS, LEAST = 0.5, 300.0, 20

#: A word that isn't plain ASCII; a no-break space belongs to it only after a character that isn't ASCII either.
CHUNK = r"(?:[^ \t\r\n\xa0]*[^\x00-\x7f\xa0])(?:[^ \t\r\n\xa0]|(?<=[^\x00-\x7f])\xa0)*"
#: Encodings whose characters are of several bytes: one of them, read back strictly, proves its chain.
WIDE = ("utf-8", "cp932", "euc_jp")
_MIXED = re.compile("[A-Za-z\u00c0-\u024f][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z\u00c0-\u024f]")
_LATIN, _CYRILLIC = re.compile("[A-Za-z\u00c0-\u024f]"), re.compile("[\u0400-\u04ff]")
_CHUNK = re.compile(CHUNK)
_C1 = {**{chr(b): bytes([b]) for b in range(0x80, 0xA0)}}


def _read(raw: bytes, enc: str, strict: bool = False) -> str | None:
    """Bytes read in an encoding; undefined bytes of single-byte encodings stand for control characters."""
    try:
        return raw.decode(enc)
    except UnicodeDecodeError:
        if strict:
            return None
    if enc in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254"):
        return "".join(bytes([b]).decode(enc, "ignore") or chr(b) for b in raw)
    return raw.decode(enc, "replace")


def _write(text: str, enc: str) -> bytes | None:
    """The bytes a text has in an encoding, control characters of C1 standing for their bytes; None if it has none."""
    try:
        return text.encode(enc)
    except UnicodeEncodeError:
        pass
    if not enc.startswith("cp125"):
        return None
    out = []
    for c in text:
        try:
            out.append(c.encode(enc))
        except UnicodeEncodeError:
            if c not in _C1:
                return None
            out.append(_C1[c])
    return b"".join(out)


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """The text after it was written and read along the chain; None where it can't be written so."""
    for k in range(0, len(chain), 2):
        raw = _write(text, chain[k])
        if raw is None:
            return None
        text = _read(raw, chain[k + 1])
    return text


def invert(text: str, chain: tuple[str, ...]) -> str | None:
    """The text before the chain; None unless every step encodes and decodes strictly."""
    for k in range(len(chain) - 2, -1, -2):
        raw = _write(text, chain[k + 1])
        text = None if raw is None else _read(raw, chain[k], strict=True)
        if text is None or "�" in text:
            return None
    return text


def _grams(word: str) -> np.ndarray:
    """Buckets of the byte bigrams of a word, its ends marked by a space; runs of ASCII say nothing and are left out."""
    raw = np.frombuffer(f" {word} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    pair = (raw[:-1] << np.uint32(8)) | raw[1:]
    pair = pair[(raw[:-1] > 127) | (raw[1:] > 127)]
    if len(pair) > 1:  # each bigram by itself and with the next: the bytes of one character overlap those of the next
        pair = np.concatenate([pair, (pair[:-1] * np.uint32(31) + pair[1:]) ^ np.uint32(0x5BD1E995)])
    return ((pair * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


class Classifier:
    """Multinomial model over hashed byte bigrams: class 0 is whole text, class k the chain k - 1."""

    def __init__(self, table: np.ndarray, floor: float = -99.0, chains: tuple[tuple[str, ...], ...] = CHAINS, sure: float = SURE, alone: float = ALONE):
        self.table, self.floor, self.chains, self.sure, self.alone = table, floor, chains, sure, alone
        self.memo: dict[str, tuple[int, str | None]] = {}

    def scores(self, word: str) -> np.ndarray:
        """Evidence for each class over class 0."""
        rows = self.table[_grams(word)].sum(0)
        return rows - rows[0]

    def judge(self, word: str) -> tuple[int, str | None]:
        """(class, the word before its chain); class 0 for whole words, and None where the chain can't be inverted."""
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = self._judge(word)
        return self.memo[word]

    def fluency(self, word: str) -> float:
        """Mean log-probability of the bigrams of a word as whole text."""
        rows = self.table[_grams(word), 0]
        return float(rows.mean()) if len(rows) else 0.0

    def _judge(self, word: str) -> tuple[int, str | None]:
        s = self.scores(word)
        order = np.argsort(-s, kind="stable")
        for k in order:
            if k == 0 or s[k] < self.sure:
                break
            back = invert(word, self.chains[k - 1])
            if back is None or back == word or _MIXED.search(back) or back.isascii() and not any(c.isalnum() for c in back):
                continue
            if back.isascii() or self.chains[k - 1][0] == "utf-8" or self.fluency(back) > max(self.fluency(word) + GAIN, self.floor):
                return int(k), back
        # What lost bytes on the way can't be read back.
        if "\ufffd" in word:
            return len(self.chains) + 1, None
        odd = s[order[0]] >= self.alone and order[0] and self.fluency(word) < self.floor
        return (int(order[0]), None) if odd else (0, None)

    def name(self, k: int) -> str:
        return " > ".join(self.chains[k - 1]) if k <= len(self.chains) else "lost"


def fit(words: dict[str, int], chains: tuple[tuple[str, ...], ...] = CHAINS, sure: float = SURE, alone: float = ALONE) -> Classifier:
    """words: each with its number of occurrences, which count by their root. Every class has the same background, so a
    class of few examples doesn't draw what no class knows. The words of the corpus hold garbled ones themselves: those
    the first fit takes for garbled are left out of the second."""
    kept = {w: n**0.5 for w, n in sorted(words.items())}
    names, weight = list(kept), np.array(list(kept.values()))
    # The bigrams of every word along every chain, once: (buckets, numbers of the words).
    along = []
    for chain in ((), *chains):
        made = [(i, _grams(g)) for i, w in enumerate(names) if (g := garble(w, chain)) is not None and (not chain or g != w and not g.isascii() and "\ufffd" not in g)]
        along.append((np.concatenate([g for _, g in made] or [np.zeros(0, dtype=np.int64)]), np.repeat([i for i, _ in made], [len(g) for _, g in made]).astype(int)))
    while True:
        counts = np.zeros((2**BITS, len(chains) + 1))
        on = np.array([w in kept for w in names], dtype=bool)
        for k, (grams, of) in enumerate(along):
            used = on[of]
            if not k or len(np.unique(of[used])) >= LEAST:
                counts[:, k] = np.bincount(grams[used], weight[of[used]], 2**BITS)
        total = counts.sum(0)
        share = counts / np.maximum(total, 1)
        ground = (share.sum(1, keepdims=True) + 1e-3 / 2**BITS) / (np.count_nonzero(total) + 1e-3)
        logp = np.log((counts + MASS * ground) / (total + MASS))
        logp[:, 1:][:, total[1:] == 0] = -40.0
        table = logp.astype(np.float32)
        strict = Classifier(table, -99.0, chains, SUSPECT, alone)
        left = {w: n for w, n in kept.items() if "\ufffd" not in w and (sum(c > "\x7f" for c in w) < 2 or not _proven(w, *strict.judge(w), chains))}
        if len(left) == len(kept):
            # No chain is read into a word without inversion unless it is less fluent than nearly all words.
            floor = np.quantile([strict.fluency(w) for w in kept], 0.02) if kept else -99.0
            return Classifier(table, float(floor), chains, sure, alone)
        kept = left


def _proven(word: str, k: int, back: str | None, chains) -> bool:
    """Whether a word shows its chain by more than its frequency: bytes that form whole UTF-8 or double-byte characters
    where they were read as others."""
    if not k or back is None:
        return k > len(chains)
    return sum(c > "\x7f" for c in word) >= 2 and chains[k - 1][0] in WIDE


def restore(text: str, model: Classifier) -> tuple[str, str | None] | None:
    """(chain, restored text or None), or None where nothing is garbled."""
    if not text or text.isascii():
        return None
    found: Counter = Counter()
    judged = {w: model.judge(w) for w in set(_CHUNK.findall(text))}
    # One odd letter is no proof of a chain between single-byte encodings: it takes a few in the text, or two scripts in
    # one word.
    odd: Counter = Counter()
    for w, (k, _) in judged.items():
        if k:
            odd[k] += 3 if k > len(model.chains) or model.chains[k - 1][0] in WIDE or _LATIN.search(w) and _CYRILLIC.search(w) else sum(c > "\x7f" for c in w)
    judged = {w: j if odd[j[0]] >= 3 else (0, None) for w, j in judged.items()}
    for k, back in judged.values():
        if k:
            found[k, back is not None] += 1
    if not found:
        return None
    (main, _), _ = found.most_common(1)[0]
    lost = False

    def put_back(m: re.Match) -> str:
        nonlocal lost
        k, back = judged[m[0]]
        if k and back is None:
            lost = True
            return m[0]
        if not k:  # no evidence of its own: as its neighbours, if that decodes strictly and reads as whole text
            if main > len(model.chains):
                return m[0]
            other = invert(m[0], model.chains[main - 1])
            return other if other is not None and model.scores(other).max() < model.sure and model.scores(m[0])[main] > 0 else m[0]
        return back

    whole = _CHUNK.sub(put_back, text)
    return model.name(main), None if lost else whole


def garbled(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """id_col, chain, restored (null where it can't be): one row for each row whose text holds garbled characters.

    Null, empty and ASCII texts give nothing; repeated rows come again; extra columns are ignored. Texts of any length
    are read whole. An empty table gives an empty one."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({CHUNK})"), 1)).alias("w")).where("length(w) <= 60")
    # The most frequent words of each script, so that rare scripts are learnt too.
    script = F.when(F.col("w").rlike(r"[\u0400-\u04ff]"), 1).when(F.col("w").rlike(r"[\u3040-\u9fff]"), 2).when(F.col("w").rlike(r"[\u2000-\u206f\u20a0-\u20cf]"), 3).otherwise(0)
    counted = staged(chunks.groupBy("w").agg(F.count("*").alias("n")).withColumn("s", script), "words")
    # Of each script the most frequent words. The words are counted by the magnitude of their counts, so that no more than
    # a few times as many as are wanted leave the tasks; of the lowest magnitude let in, a hash decides.
    sizes = counted.groupBy("s", F.floor(F.log2("n")).alias("m")).agg(F.count("*").alias("k")).collect()  # at most 64 a script
    picked: dict[str, int] = {}
    for s in sorted({r.s for r in sizes}):
        held, low, part = 0, 0, 1.0
        for m, k in sorted(((r.m, r.k) for r in sizes if r.s == s), reverse=True):
            low, part = m, min(1.0, 2 * max(words - held, 0) / k)
            held += k
            if held >= words:
                break
        let_in = (F.floor(F.log2("n")) > low) | ((F.floor(F.log2("n")) == low) & (F.pmod(F.xxhash64("w"), F.lit(2**31)) < F.lit(int(2**31 * part))))
        picked |= {r.w: r.n for r in counted.where(F.col("s") == s).where(let_in).orderBy(F.desc("n"), "w").limit(words).collect()}
    drop(counted)
    model = fit(picked)
    kept = spark.sparkContext.broadcast((model.table, model.floor))

    def run(batches):
        import pyarrow as pa

        m = Classifier(*kept.value)
        for batch in batches:
            hits = [(n, *k) for n, t in enumerate(batch.column(1).to_pylist()) if (k := restore(t, m))]
            ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([h[1] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.string())], names=[id_col, "chain", "restored"])

    return docs.where(F.col(text).isNotNull()).select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, chain string, restored string")
