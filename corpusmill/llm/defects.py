"""Problem 7: defective prompt-answer pairs.

Method: one multi-label linear classifier over hashed n-grams of the answer and features of the pair. It is trained on
pairs of the corpus itself and on defects made from them: answers cut at random places, prompts given back, answers
swapped with those of pairs in another language, refusals, and emptied answers. Each label's threshold is calibrated on
held-out examples. An exact check follows for the labels that have one (nothing to read; all of the answer stands in the
prompt; the end is open by the evidence of the truncation operator; the answer's language is not the one expected).

The classifier is fitted on the driver, on at most ``SAMPLE`` pairs and ``TEXTS`` labelled texts a language (chosen by
hash, so the choice doesn't depend on partitions); everything else covers all rows in two narrow passes and joins of a
few small columns.
"""

from __future__ import annotations

import json
import random
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import truncation

#: Bounds of the training sample: pairs, labelled texts a language, and the characters of a text that are learnt from.
SAMPLE, TEXTS, LEARNT = 1500, 150, 20_000
#: Raw pairs teach what whole answers are. Those of fewer characters may well be refusals themselves, so none is taken;
#: short whole answers are made from single sentences of the others.
BRIEF = 300
BITS = 16
#: Step of the fit; what F1 a threshold may lose for more recall where an exact check follows; decay of the weights of
#: the n-grams (strong: only what many examples share is to count).
RATE, SLACK, DECAY = 0.8, 0.002, 0.3
LABELS = ("empty", "truncated", "refusal", "copy", "language")

#: English names of languages, as a prompt may ask for one.
LANGUAGES = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "russian": "ru", "japanese": "ja", "chinese": "zh", "korean": "ko", "dutch": "nl", "polish": "pl"}
_ASKED = re.compile(r"\b(?:answer|reply|respond|write|written|translate)\b[^.!?\n]{0,40}?\b(?:in|into)\s+(" + "|".join(LANGUAGES) + r")\b", re.I)

_CJK = "\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3"
_TOKEN = re.compile(rf"[{_CJK}]|[^\W\d_{_CJK}]+")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)(?:"|\Z)\s*(:?)', re.S)
_FENCE = re.compile(r"```\w*|~~~\w*")
_ESCAPE = re.compile(r'\\(?:u([0-9a-fA-F]{4})|(.))', re.S)
#: Keys whose values say what an answer is, not what it says.
SHAPE_KEYS = frozenset({"payload_type"})

#: Parts refusals are put together from, for training only.
_SORRY = {
    "en": (["I'm sorry, but", "Sorry,", "Unfortunately", "I apologise, but", "Regrettably,", "No.", "I must say that", "As an AI assistant", "As a language model", ""], ["I can't", "I cannot", "I am unable to", "I won't be able to", "I am not able to", "I must decline to", "I do not feel comfortable to", "it is not possible for me to", "I can not", "I will not"], ["help with that request.", "assist with this.", "answer this question.", "provide advice of this kind.", "give guidance here.", "answering that.", "comply with your request.", "respond to this prompt.", "discuss this topic.", "do what you ask."]),
    "de": (["Es tut mir leid, aber", "Leider", "Entschuldigung,"], ["ich kann", "kann ich"], ["dabei nicht helfen.", "diese Frage nicht beantworten.", "dazu keine Auskunft geben."]),
    "fr": (["Je suis désolé, mais", "Désolé,", "Malheureusement,"], ["je ne peux pas", "je ne suis pas en mesure de"], ["vous aider avec cela.", "répondre à cette question.", "donner ce genre de conseils."]),
    "es": (["Lo siento, pero", "Lamentablemente", "Perdón,"], ["no puedo", "no me es posible"], ["ayudar con eso.", "responder a esa pregunta.", "dar consejos de este tipo."]),
    "it": (["Mi dispiace, ma", "Purtroppo", "Spiacente,"], ["non posso", "non sono in grado di"], ["aiutarti con questo.", "rispondere a questa domanda.", "dare consigli di questo tipo."]),
    "pt": (["Desculpe,", "Infelizmente", "Lamento, mas"], ["não posso", "não consigo"], ["ajudar com isso.", "responder a esta pergunta.", "dar conselhos deste tipo."]),
    "ru": (["Извините, но", "К сожалению,"], ["я не могу", "я не в состоянии"], ["помочь с этим запросом.", "ответить на этот вопрос."]),
    "ja": (["申し訳ありませんが、", "すみませんが、"], ["そのご依頼には", "この質問には"], ["お答えできません。", "対応できません。", "お手伝いできません。"]),
}
_WHOLE = ["This is not something I can answer.", "This request goes against my guidelines, so I have to decline.", "No answer can be given to this prompt under the current policy.", "That is outside of what I am allowed to do.", "I must decline: this would go against my guidelines.", "My policy does not allow an answer to this.", "I have to refuse this request.", "Answering this is against the rules I follow."]
_AFTER = ["", "", "", "Please consult the official site.", "Try asking about something else.", "Please ask a professional instead.", "Let me know if there is anything else."]


def said(answer: str) -> str:
    """What there is to read in an answer: of JSON the string values (a cut last one too), else the text; no fences."""
    text = _FENCE.sub(" ", answer or "")
    at = text.find("{")
    if at >= 0 and ('":' in text or '" :' in text or not text[:at].strip() and not text.rstrip()[at + 1 :].strip(" \n\t}")):
        values, key = [], None
        for v, named in _STRING.findall(text, at):
            if not named and key not in SHAPE_KEYS:
                values.append(v)
            key = v if named else None
        text = text[:at] + "\n" + "\n".join(_ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " " if m[2] in "nrtbf" else m[2], v) if "\\" in v else v for v in values)
    return "" if text.strip() in ("null", "None", "[]", "{}") else text


def _words(texts: list[str], cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text), for a whole batch."""
    hashes, sizes = [], []
    for t in texts:
        ws = _TOKEN.findall(t.lower())
        sizes.append(len(ws))
        for w in ws:
            h = cache.get(w)
            if h is None:
                h = cache[w] = zlib.crc32(w.encode("utf-8", "replace"))
            hashes.append(h)
    return np.array(hashes, dtype=np.uint64), np.repeat(np.arange(len(texts)), sizes)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _grams(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words, its text)."""
    if len(h) < n:
        return h[:0], owner[:0]
    out = h[: len(h) - n + 1] * _MIX
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : len(h) - n + 1 + k]
    same = owner[: len(owner) - n + 1] == owner[n - 1 :]
    return out[same], owner[: len(owner) - n + 1][same]


def _bucket(g: np.ndarray) -> np.ndarray:
    return ((g * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


#: Pair features that a batch gives by itself; those of the end of the answer come from the truncation operator.
DENSE = ("bias", "empty", "brief", "one_line", "in_prompt", "all_in_prompt", "whole_prompt", "other_language", "asked")
ENDS = ("json_open", "noted", "inside_word", "cut")


class Model:
    """Weights of the classifier and of the language model it uses."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table
        self.w = np.zeros((2**BITS, len(LABELS)), dtype=np.float32)
        self.dense = np.zeros((len(DENSE) + len(ENDS), len(LABELS)))
        self.threshold = np.zeros(len(LABELS))

    def language(self, h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(score a word of each text in each language, words that say something)."""
        rows = self.table[_bucket(h)]
        out = np.stack([np.bincount(owner, rows[:, k], n) for k in range(len(self.langs))], axis=1) if len(self.langs) else np.zeros((n, 0))
        told = np.bincount(owner, np.any(rows != 0, axis=1), n)
        return out / np.maximum(told, 1)[:, None], told

    def features(self, prompts: list[str | None], answers: list[str | None]):
        """(dense features, buckets of the n-grams, their texts, the exact checks)."""
        n, cache = len(prompts), {}
        contents = [said(a or "") for a in answers]
        hp, op = _words([p or "" for p in prompts], cache)
        ha, oa = _words(contents, cache)
        count = np.bincount(oa, minlength=n)
        # An answer is empty if there is no letter and no digit to read.
        empty = np.array([not c and not re.search(r"\w", t.replace("_", "")) for c, t in zip(count, contents)])
        shares = []
        for k in (1, 3):
            (gp, tp), (ga, ta) = _grams(hp, op, k), _grams(ha, oa, k)
            pair = lambda g, t: (g ^ (t.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))) * _MIX
            both = lambda g1, t1, g2, t2: np.bincount(t1, np.isin(pair(g1, t1), pair(g2, t2)), n) / np.maximum(np.bincount(t1, minlength=n), 1)
            shares.append((both(ga, ta, gp, tp), both(gp, tp, ga, ta)))
        (one, _), (three, back) = shares
        inside = np.where(count >= 3, np.minimum(one, three), 0.0)
        copied = (inside >= 0.95) & (back >= 0.6)
        lp, told_p = self.language(hp, op, n)
        la, told_a = self.language(ha, oa, n)
        asked = [m[-1].lower() if (m := _ASKED.findall(p or "")) else None for p in prompts]
        gap, other = np.zeros(n), np.zeros(n, dtype=bool)
        if self.langs:
            best = lp.argmax(1)
            for i, a in enumerate(asked):
                if a and LANGUAGES[a] in self.langs:
                    best[i] = self.langs.index(LANGUAGES[a])
            gap = la.max(1) - la[np.arange(n), best]
            other = (told_a >= 3) & (told_p >= 3) & (gap > 1.0)
        dense = np.stack([np.ones(n), empty, (count > 0) & (count <= 40), np.array([t.strip().count("\n") < 2 for t in contents]), inside, inside >= 0.95, copied, other, np.array([a is not None for a in asked])], axis=1).astype(float)
        grams = [_grams(ha, oa, k) for k in (1, 2, 3)]
        return dense, np.concatenate([_bucket(g + np.uint64(k)) for k, (g, _) in enumerate(grams)]), np.concatenate([t for _, t in grams]), dict(empty=empty, copy=copied, language=other)

    def partial(self, prompts, answers):
        """(scores without the features of the end, exact checks)."""
        n = len(prompts)
        dense, at, owner, exact = self.features(prompts, answers)
        scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
        rows = self.w[at]
        text = np.stack([np.bincount(owner, rows[:, k], n) * scale for k in range(len(LABELS))], axis=1) if n else np.zeros((0, len(LABELS)))
        return text + dense @ self.dense[: len(DENSE)], exact


def fit_languages(texts: list[tuple[str, str]]) -> Model:
    """Multinomial language model over hashed words: the log-probability of each word in each language, less its mean."""
    langs = sorted({lang for _, lang in texts})
    if not langs:
        return Model([], np.zeros((2**BITS, 0), dtype=np.float32))
    counts = np.zeros((2**BITS, len(langs)))
    for lang in langs:
        h, _ = _words([said(t) for t, l in texts if l == lang], {})
        counts[:, langs.index(lang)] += np.bincount(_bucket(h), minlength=2**BITS)
    seen = counts.sum(1) >= 2
    logp = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * 2**BITS))
    table = np.where(seen[:, None], logp - logp.mean(1, keepdims=True), 0).astype(np.float32)
    # Words that tell nothing (names, digits) are left out.
    table[np.ptp(table, axis=1) < 2.5] = 0
    return Model(langs, table)


def _refusal(r: random.Random, lang: str) -> str:
    if lang not in _SORRY or (lang == "en" and r.random() < 0.3):
        text = r.choice(["", "", "Sorry, ", "Unfortunately, "]) + r.choice(_WHOLE)
    else:
        text = " ".join(r.choice(x) for x in _SORRY[lang]).strip()
    after = r.choice(_AFTER)
    return (text[:1].upper() + text[1:] + " " + after).strip()


def _shell(r: random.Random, example: str, text: str) -> str:
    """The outer object of a JSON answer, emptied, with the text in its first string field; else the text."""
    try:
        whole = json.loads(example)
    except ValueError:
        return text
    whole = whole[0] if isinstance(whole, list) and whole else whole
    if not isinstance(whole, dict):
        return text
    out, done = {}, False
    for k, v in whole.items():
        if k in SHAPE_KEYS:
            out[k] = v
        elif isinstance(v, str):
            out[k] = "" if done else text
            done = True
        else:
            out[k] = type(v)() if isinstance(v, (list, dict)) else None
    return json.dumps(out, ensure_ascii=False, indent=r.choice([None, 1, 2]))


def make_examples(pairs: list[tuple[str, str]], model: Model, seed: int = 7) -> list[tuple[str, str, int]]:
    """(prompt, answer, label number or -1): the pairs, and defects made of them."""
    r, out = random.Random(seed), []
    lang = []
    for p, a in pairs:
        h, o = _words([said(a)], {})
        s, told = model.language(h, o, 1)
        lang.append(model.langs[int(s.argmax())] if told[0] >= 3 else None)
    by_lang: dict[str, list[int]] = {}
    for i, l in enumerate(lang):
        by_lang.setdefault(l or "", []).append(i)
    envelopes = [a for _, a in pairs if a.lstrip().startswith("{") and a.rstrip().endswith("}")]
    for i, (p, a) in enumerate(pairs):
        out.append((p, a, -1))
        wrap = lambda text: _shell(r, r.choice(envelopes), text) if envelopes and r.random() < 0.5 else text  # noqa: B023, E731
        if len(a) > 80:
            k = r.randrange(len(a) // 6, len(a) - 12)
            out.append((p, a[:k] + r.choice(["", "", "", "", "\n```", "…", "...", " [cut]", "\ufffd"]), 1))
        out.append((p, wrap(_refusal(r, r.choice([lang[i] or "en", "en", r.choice(list(_SORRY))]))), 2))
        if len(p) > 20:
            form = r.choice([str, str.lower, lambda t: re.sub(r"\s+", " ", t), lambda t: f'"{t}"', str.upper])
            out.append((p, wrap(form(p)), 3))
        asked = LANGUAGES[m[-1].lower()] if (m := _ASKED.findall(p)) else lang[i]
        others = [l for l in by_lang if l and l != asked]
        if lang[i] and others:
            other = pairs[r.choice(by_lang[r.choice(others)])][1]
            some = re.findall(r"[^.!?。\n]{12,}[.!?。]", said(other))
            if some and r.random() < 0.35:  # short ones too
                other = " ".join(t.strip() for t in some[: r.randrange(1, 4)])
            out.append((p, other, 4))
        if r.random() < 0.4:
            out.append((p, wrap(r.choice(["", " ", "\n\n", "null", "{}", "```json\n```", "[]", "-", "..."])), 0))
        whole = [t for t in re.split(r"(?<=[.!?。])\s+|\n", said(a).strip())[:-1] if len(t) > 3]
        if whole:
            first = r.choice(whole)
            out.append((p, wrap(first) if r.random() < 0.3 else first, -1))
    return out


def ends_of(tails: DataFrame) -> list[Column]:
    """The features of the answer's end, as 0 or 1, and the columns of the exact check."""
    return [(F.col("json") == 2).cast("double").alias("json_open"), (F.col("noted") & ~F.col("closed")).cast("double").alias("noted"), (truncation.unknown_prefix() & ~F.col("closed")).cast("double").alias("inside_word"), F.coalesce(truncation.cut_off(), F.lit(False)).cast("double").alias("cut")]


def fit(model: Model, examples: list[tuple[str, str, int]], ends: np.ndarray, rounds: int = 40) -> None:
    """Logistic regression of each label, by full-batch AdaGrad; the raw pairs that the first fit takes for defective are
    left out of the second. Every third example is held out, and each threshold is the one of best F1 on these."""
    dense, at, owner, _ = model.features([e[0] for e in examples], [e[1] for e in examples])
    x = np.concatenate([dense, ends], axis=1)
    n = len(examples)
    y = np.zeros((n, len(LABELS)))
    for i, e in enumerate(examples):
        if e[2] >= 0:
            y[i, e[2]] = 1
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    used, packed = np.unique(at, return_inverse=True)
    keep = np.ones(n, dtype=bool)
    held = np.arange(n) % 3 == 2
    for _ in range(2):
        w, d = np.zeros((len(used), len(LABELS))), np.zeros((x.shape[1], len(LABELS)))
        gw, gd = np.full_like(w, 1e-8), np.full_like(d, 1e-8)
        train = keep & ~held
        rows = train[owner]
        pr, ow = packed[rows], owner[rows]
        for _ in range(rounds):
            for c in range(len(LABELS)):
                z = np.bincount(ow, w[pr, c], n) * scale + x @ d[:, c]
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[:, c]) * train
                g = np.bincount(pr, (err * scale)[ow], len(used)) + DECAY * w[:, c]
                gw[:, c] += g * g
                w[:, c] -= RATE * g / np.sqrt(gw[:, c])
                g = x.T @ err + 1e-3 * d[:, c]
                gd[:, c] += g * g
                d[:, c] -= RATE * g / np.sqrt(gd[:, c])
        z = np.stack([np.bincount(owner, w[packed, c], n) * scale for c in range(len(LABELS))], axis=1) + x @ d
        raw = np.array([e[2] < 0 for e in examples])
        keep = ~(raw & (z.max(1) > 0))
    model.w[used], model.dense = w, d
    for c in range(len(LABELS)):
        zs, ys = z[held & keep, c], y[held & keep, c]
        tries = np.linspace(-2, 4, 61)
        f1 = [2 * ((zs > t) & (ys > 0)).sum() / max((zs > t).sum() + ys.sum(), 1) for t in tries]
        checked = LABELS[c] != "refusal"
        good = np.flatnonzero(np.array(f1) >= max(f1) - (SLACK if checked else 1e-9))
        model.threshold[c] = tries[good[0 if checked else len(good) // 2]]


def pairs_of(*tables: tuple[str, DataFrame, str, Column, Column]) -> DataFrame:
    """table_name, id, prompt, answer, source, h of each (name, table, prompt column, answer, source)."""
    out = None
    for name, df, prompt, answer, source in tables:
        one = df.select(F.lit(name).alias("table_name"), F.col("id").cast("string").alias("id"), F.col(prompt).alias("prompt"), F.coalesce(answer, F.lit("")).alias("answer"), F.coalesce(source, F.lit("")).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("h", F.xxhash64("prompt", "answer"))


KEY = ["table_name", "id", "source", "h"]


def defects(pairs: DataFrame, labelled: DataFrame, seed: int = 7) -> DataFrame:
    """table_name, id, defect: one row for each pair (as pairs_of gives them) with a defect.

    labelled: text, lang, for the language model; languages of fewer than 20 texts are left out, and null ones. A pair
    with several defects has the one whose score is furthest above its threshold. Null answers count as empty ones; null
    prompts are empty. A repeated pair comes once. An empty table gives an empty one.
    """
    spark = pairs.sparkSession
    got = truncation.survey(pairs.select(*KEY, "answer"), KEY, "answer")
    tails, counts = got.where("kind = 't'").drop("kind", "n"), got.where("kind <> 't'")

    known = labelled.select(F.substring("text", 1, LEARNT).alias("text"), F.lower("lang").alias("lang")).where("length(trim(text)) > 20 and lang rlike '^[a-z]{2}$'")
    # Of each language the texts of least hash: grouped maps of bounded size, combined before the shuffle.
    picked = known.withColumn("b", F.pmod(F.xxhash64("text"), F.lit(TEXTS))).groupBy("lang", "b").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = [(r.text, r.lang) for r in picked.collect()]  # at most TEXTS a language
    sizes = {l: sum(x == l for _, x in texts) for _, l in texts}
    model = fit_languages([t for t in texts if sizes[t[1]] >= min(20, TEXTS // 2)])
    # The pairs of least hash. A threshold leaves a few times as many as are wanted, so the tasks send no more than those.
    long_ = tails.where(F.col("chars") > BRIEF).count()
    below = F.pmod(F.xxhash64("h"), F.lit(2**31)) < F.lit(int(2**31 * min(1.0, 4 * SAMPLE / max(long_, 1))))
    sample = pairs.select(F.substring("prompt", 1, LEARNT).alias("prompt"), F.substring("answer", 1, LEARNT).alias("answer"), "h").where(below & (F.length("answer") > BRIEF)).orderBy(F.pmod(F.xxhash64("h"), F.lit(2**31)), "h").limit(SAMPLE)
    rows = [(r.prompt or "", r.answer) for r in sample.collect()]
    schema = "table_name string, id string, defect string"
    if not rows:
        return spark.createDataFrame([], schema)
    examples = make_examples(rows, model, seed)
    made = [(i, "", *truncation.tail_of(e[1]).values()) for i, e in enumerate(examples)]
    made = spark.createDataFrame(made, "i int, source string, " + truncation.TAIL)
    shown = truncation.evidence(made, counts).select("i", *ends_of(made)).collect()  # at most a few per sampled pair
    ends = np.zeros((len(examples), len(ENDS)))
    for r in shown:
        ends[r.i] = list(r)[1:]
    fit(model, examples, ends)

    kept = spark.sparkContext.broadcast((model.langs, model.table, model.w, model.dense))
    names = [*KEY, *(f"s_{x}" for x in LABELS), "is_empty", "is_copy", "is_other"]

    def score(batches):
        import pyarrow as pa

        m = Model(kept.value[0], kept.value[1])
        m.w, m.dense = kept.value[2], kept.value[3]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                s, exact = m.partial(b.column(4).to_pylist(), b.column(5).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(s[:, k], pa.float64()) for k in range(len(LABELS))), *(pa.array(exact[x]) for x in ("empty", "copy", "language"))], names=names)

    scored = pairs.select(*KEY, "prompt", "answer").mapInArrow(score, "table_name string, id string, source string, h long, " + ", ".join(f"s_{x} double" for x in LABELS) + ", is_empty boolean, is_copy boolean, is_other boolean")
    # Most ends are closed: what the tails show is joined for the others only.
    open_ends = truncation.evidence(tails, counts, "source").where("json = 2 or not closed").select(*KEY, *ends_of(tails)).where("json_open + noted + inside_word + cut > 0").distinct()
    told = scored.distinct().join(open_ends, KEY, "left").fillna(0.0, list(ENDS))
    base = len(DENSE)
    total = {x: F.col(f"s_{x}") + sum((F.col(e) * F.lit(float(model.dense[base + k, c])) for k, e in enumerate(ENDS)), F.lit(0.0)) - F.lit(float(model.threshold[c])) for c, x in enumerate(LABELS)}
    exact = {"empty": F.col("is_empty"), "truncated": (F.col("cut") > 0) & ~F.col("is_empty"), "refusal": ~F.col("is_empty") & ~F.col("is_copy"), "copy": F.col("is_copy"), "language": F.col("is_other")}
    best = F.array_max(F.array(*(F.when((total[x] > 0) & exact[x], F.struct(total[x].alias("over"), F.lit(x).alias("defect"))) for x in LABELS)))
    return told.select("table_name", "id", best.alias("b")).where("b is not null").select("table_name", "id", F.col("b.defect").alias("defect")).distinct()
