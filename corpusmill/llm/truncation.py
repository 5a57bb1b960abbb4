"""Problem 5: texts that stop before their end.

Method: a trie of the corpus vocabulary, built in the cluster (one row a prefix: how often it stands as a word, how many
longer words go on from it); a text whose final token is no known word but a proper prefix of known ones was cut inside
a word. Where the cut fell between words, length evidence decides: the text has the exact length at which its source
cuts, or its last segment is shorter than the whole segments that open like it, or ends in a word that whole segments
hardly ever end in. JSON text is cut where a bracket or string of it is left open.

One pass over the texts takes the counts and each text's tail; all joins are on the few columns of the tails. The final
tokens are distinct before they meet the trie, so no frequent token gathers rows.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut, join_hot, staged

_WORD = re.compile(r"\w+")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_SEGMENT = re.compile(r"(?<=[.!?。！？])[\"'”’»)*]*\s+|(?<=[。！？])|\n+")
#: What a transfer may append after a cut: dots, a replacement character, a fence, a short note in brackets.
_APPENDED = re.compile(r"(?:\s*(?:\.{3,}|…|�|```\w*|[\[<][\w .…-]{1,24}[\]>]|\((?:cut|trunc\w*|continue\w*|more|end|snip\w*)\b[\w .…-]*\)))+\s*$")
_NOTE = re.compile(r"(?:\.{3,}|…|�|[\[<(]\W*(?:cut|trunc\w*|continue\w*|more|end|snip\w*)\b[\w .…-]*[\])>])\s*$", re.I)
#: Marks that close a sentence, and what may stand after them.
_CLOSED = re.compile(r"[.!?。！？:;][\"'”’»)\]*_`]*$|[)\]}\"”»*_]$")
_LONGEST = 64
#: A whole segment is as long as this share of those that open like it, at least.
SHORT = 0.005
FEW = 20

TAIL = "json int, closed boolean, noted boolean, running boolean, url boolean, token string, opener string, words int, chars int"


def _json_open(text: str) -> int:
    """0: no JSON in it; 1: JSON that was closed, or is faulty in another way; 2: a bracket or string was left open."""
    at = text.find("{")
    if at < 0 or not (text[:at].strip() == "" or '":' in text or at == text.rfind("{") or text[at : at + 3].strip()[1:2] in ('"', "")):
        return 0
    if '"' not in text[at : at + 400] and "}" in text[at:]:
        return 1 if text.count("{") <= text.count("}") else 0
    bare = _STRING.sub("", text[at:])
    quote = bare.find('"')
    if quote >= 0:
        bare = bare[:quote]
    depth = bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")
    if depth <= 0:
        return 1
    # Quotes that aren't escaped upset the strings: brackets that balance without regard to them show a whole text.
    if text.rstrip(" \n`").endswith("}") and text.count("{", at) == text.count("}", at):
        return 1
    return 2


def tail_of(text: str) -> dict:
    """What the end of a text shows (columns of TAIL), without the corpus."""
    out = dict(json=0, closed=True, noted=False, running=False, url=False, token=None, opener=None, words=0, chars=len(text))
    out["json"] = _json_open(text)
    if out["json"] == 2 or not text.strip():
        return out
    body = _APPENDED.sub("", text).rstrip()
    if not body or out["json"] == 1 and body.endswith("}"):
        return out
    out["noted"] = bool(_NOTE.search(text.rstrip().removesuffix("```").rstrip()))
    line = body[body.rfind("\n") + 1 :]
    parts = [p for p in _SEGMENT.split(line) if p and _WORD.search(p)]
    last = parts[-1] if parts else line
    ws = _WORD.findall(last.lower())
    tip = body[-1]
    out["closed"] = bool(_CLOSED.search(body)) or not (tip.isalnum() or tip in ",-–—_'’`/&¿¡(") or not ws
    if out["closed"] and body.endswith(tuple(":;")) and not body.endswith(("\n:", "\n;")):
        out["closed"] = not len(parts) > 1
    out["running"] = len(parts) > 1
    out["url"] = "://" in last.split()[-1] or "@" in last.split()[-1] if last.split() else False
    if ws:
        token = ws[-1]
        out["token"] = "#" if token.isdigit() else token if tip.isalnum() else None
        out["opener"], out["words"] = ws[0] if not ws[0].isdigit() else "#", min(len(ws), _LONGEST)
    return out


def _counts(text: str, words: Counter, ends: Counter, openers: Counter) -> None:
    """Words that aren't the text's last one; last words and lengths of segments that aren't its last one."""
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    low = text.lower()
    ws = _WORD.findall(low)
    if not ws:
        return
    words.update(ws[:-1])
    if '":' in text:
        return
    for part in _SEGMENT.split(low)[:-1]:
        ws = _WORD.findall(part)
        if ws:
            ends["#" if ws[-1].isdigit() else ws[-1]] += 1
            openers["#" if ws[0].isdigit() else ws[0], min(len(ws), _LONGEST)] += 1


def survey(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """One pass: rows of the tails (kind 't', the key columns and TAIL) and of the counts ('w', 'e', 'o': token, opener,
    words, n), staged."""
    kinds = [texts.schema[k].dataType.simpleString() for k in key]
    names = [*key, "kind", *(c.split()[0] for c in TAIL.split(", ")), "n"]

    def run(batches):
        import pyarrow as pa

        types = dict(kind=pa.string(), json=pa.int32(), closed=pa.bool_(), noted=pa.bool_(), running=pa.bool_(), url=pa.bool_(), token=pa.string(), opener=pa.string(), words=pa.int32(), chars=pa.int32(), n=pa.int64())

        def rows(keys, cols: dict, size: int):
            return pa.RecordBatch.from_arrays([*keys, *(pa.array(cols[c], t) if c in cols else pa.nulls(size, t) for c, t in types.items())], names=names)

        words, ends, openers, key_types = Counter(), Counter(), Counter(), None

        def flush():
            for kind, c in (("w", words), ("e", ends), ("o", openers)):
                items = [("#" if k.isdigit() else k, n) for k, n in c.items()] if kind != "o" else list(c.items())
                for at in range(0, len(items), 20_000):
                    part = items[at : at + 20_000]
                    cols = dict(kind=[kind] * len(part), n=[n for _, n in part])
                    if kind == "o":
                        cols |= dict(opener=[k[0] for k, _ in part], words=[k[1] for k, _ in part])
                    else:
                        cols |= dict(token=[k for k, _ in part])
                    yield rows([pa.nulls(len(part), t) for t in key_types], cols, len(part))
                c.clear()

        for batch in batches:
            key_types = [c.type for c in batch.columns[:-1]]
            tails = []
            for t in batch.column(len(key)).to_pylist():
                tails.append(tail_of(t))
                _counts(t, words, ends, openers)
            cols = {c: [t[c] for t in tails] for c in tails[0]} if tails else {}
            yield rows(batch.columns[:-1], cols | dict(kind=["t"] * len(tails)), len(tails))
            if len(words) > 200_000:  # only the memory of one task
                yield from flush()
        if key_types:
            yield from flush()

    schema = ", ".join(f"`{k}` {t}" for k, t in zip(key, kinds)) + f", kind string, {TAIL}, n long"
    return staged(texts.where(F.col(text).isNotNull()).select(*key, text).mapInArrow(run, schema), "tails")


def trie(counts: DataFrame) -> DataFrame:
    """prefix, n (times it stands as a word), longer (words that go on from it): the nodes of the vocabulary trie."""
    words = counts.where("kind = 'w'").groupBy("token").agg(F.sum("n").alias("n"))
    nodes = words.select("token", "n", F.explode(F.sequence(F.lit(1), F.least(F.length("token"), F.lit(40)))).alias("k"))
    return nodes.groupBy(F.substring("token", F.lit(1), F.col("k")).alias("prefix")).agg(F.sum(F.when(F.length("token") == F.col("k"), F.col("n"))).alias("n"), F.count_if(F.length("token") > F.col("k")).alias("longer"))


def evidence(tails: DataFrame, counts: DataFrame, source: str | None = None) -> DataFrame:
    """The tails with: word_n, longer (from the trie), end_n (whole segments that end in the token), like_n and like_le
    (whole segments that open alike, and those of them not longer), own and own_all (texts that end in a line of the same
    opener and length, and of the same opener), and with ``source`` also at_limit."""
    # Only open tails need the corpus (the others have no token to look up: they would all meet in one task). Their tokens
    # are counted first, so the trie is asked for each once and frequent ones are joined apart.
    open_ = (F.col("json") < 2) & ~F.col("closed")
    ask, rest = tails.where(open_), tails.where(~open_)
    tokens = ask.where("token is not null").groupBy("token").agg(F.count("*").alias("asked"))
    found = tokens.join(trie(counts), tokens["token"] == F.col("prefix"), "left").drop("prefix")
    found = cut(found.join(counts.where("kind = 'e'").groupBy("token").agg(F.sum("n").alias("end_n")), "token", "left").select("token", "asked", F.col("n").alias("word_n"), "longer", "end_n"))
    lengths = counts.where("kind = 'o'").groupBy("opener", "words").agg(F.sum("n").alias("k"))
    shapes = cut(ask.where("opener is not null").groupBy("opener", F.col("words").alias("w")).agg(F.count_if(~F.col("running")).alias("own")))
    like = shapes.join(lengths, "opener", "left").groupBy("opener", "w", "own").agg(F.sum("k").alias("like_n"), F.sum(F.when(F.col("words") <= F.col("w"), F.col("k")).otherwise(0)).alias("like_le"))
    like = like.join(shapes.groupBy("opener").agg(F.sum("own").alias("own_all")), "opener")
    out = join_hot(ask.where("token is not null"), found, "token", "asked").unionByName(ask.where("token is null"), allowMissingColumns=True)
    out = out.join(like.withColumnRenamed("w", "words"), ["opener", "words"], "left").unionByName(rest, allowMissingColumns=True)
    if source is None:
        return out.withColumn("at_limit", F.lit(False))
    # A length is a source's limit if texts pile up on it and most of these end openly.
    piles = tails.groupBy(source, "chars").agg(F.count("*").alias("pile"), F.count_if((F.col("json") == 2) | ~F.col("closed")).alias("open"))
    limits = piles.where("open >= 5 and open * 2 > pile").select(F.col(source).alias("_s"), F.col("chars").alias("_c"), F.lit(True).alias("_at"))
    return out.join(limits, (out[source] == F.col("_s")) & (out["chars"] == F.col("_c")), "left").withColumn("at_limit", F.coalesce("_at", F.lit(False))).drop("_s", "_c", "_at")


def unknown_prefix() -> Column:
    """The final token is no known word, but known words go on from it."""
    return F.coalesce((F.coalesce("word_n", F.lit(0)) == 0) & (F.coalesce("longer", F.lit(0)) > 0) & ~F.col("url"), F.lit(False))


def cut_off() -> Column:
    """Whether the evidence says that the text was cut."""
    ends = lambda share: F.coalesce("end_n", F.lit(0)) >= F.lit(share) * F.coalesce("word_n", F.lit(1))
    no = lambda c: F.coalesce(c, F.lit(False))
    long_enough = no((F.col("like_n") >= FEW) & (F.col("like_le") >= F.lit(0.2) * F.col("like_n")))
    # A line of its own as many texts end in (a source, a greeting): cuts fall anywhere, not always after as many words.
    usual = no(~F.col("running") & (F.col("own") >= FEW) & (F.col("own") >= F.lit(0.2) * F.col("own_all")))
    never_ends = no((F.coalesce("end_n", F.lit(0)) < F.lit(0.02) * F.coalesce("word_n", F.lit(0))) & (F.col("word_n") >= FEW)) & ~long_enough
    too_short = no((F.col("like_n") >= FEW) & (F.col("like_le") < F.lit(SHORT) * F.col("like_n")))
    mostly_ends = no(ends(0.8)) | (long_enough & no(ends(0.1)))
    by_shape = (too_short | never_ends | (F.col("running") & ~mostly_ends)) & ~usual
    open_end = ~F.col("closed") & (F.col("noted") | F.col("token").isNull() | unknown_prefix() | F.col("at_limit") | by_shape)
    return (F.col("json") == 2) | (open_end & ~(F.col("url") & ~F.col("noted")))


def truncated(texts: DataFrame, id_col: str = "id", text: str = "output_text", source: str = "source") -> DataFrame:
    """id_col, source, chars, cut: one row for each row with a text.

    Null texts give no row; empty and blank texts are not cut. Repeated rows come again. Null sources have no limit
    of their own. Extra columns are ignored. Texts of any length are read whole."""
    got = survey(texts.select(id_col, source, text), [id_col, source], text)
    return evidence(got.where("kind = 't'").drop("kind", "n"), got.where("kind <> 't'"), source).select(id_col, source, "chars", cut_off().alias("cut"))
