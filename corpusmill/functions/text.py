"""Text columns: normal forms, tokens, shingles, similarity, fingerprints, phrase counts. All are Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import fixed


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without outer Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column | str) -> Column:
    """White space collapsed to single spaces, stripped, lower case; null gives ''."""
    return F.lower(strip(F.regexp_replace(_text(c), r"(?U)\s+", " ")))


def plain(c: Column | str) -> Column:
    """Lower case and stripped, inner white space kept; null gives ''."""
    return strip(F.lower(_text(c)))


def tokens(c: Column | str, lower: bool = False) -> Column:
    """ASCII punctuation deleted, then split at white space; no empty tokens."""
    t = F.regexp_replace(_text(c), r"\p{Punct}", "")
    return F.filter(F.split(F.lower(t) if lower else t, r"(?U)\s+"), lambda x: x != "")


def shingles(words: Column, k: int = fixed.SHINGLE_SIZE) -> Column:
    """Distinct runs of k tokens; fewer than k tokens give none."""
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, k), " ")))
    return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def hex_mod(digest: Column, modulo: int, words: int) -> Column:
    """A hexadecimal digest of 16 x words digits modulo a number, folded over its 64-bit words (any modulus below 2^31)."""
    out = F.lit(0).cast("decimal(38,0)")
    for k in range(words):
        part = F.conv(F.substring(digest, 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")
        out = (out * F.lit(2**64 % modulo) + part) % F.lit(modulo)
    return out.cast("bigint")


def bucket_id(sh: Column, modulo: int = fixed.BUCKET_MODULO, digest: str = "md5") -> Column:
    """Digest of the least shingle modulo a number; 0 for no shingles. digest: "md5", or "sha256" as the splitter has it."""
    least = F.array_min(sh)
    h = hex_mod(F.md5(least), modulo, 2) if digest == "md5" else hex_mod(F.sha2(least, 256), modulo, 4)
    return F.when(F.size(sh) == 0, F.lit(0).cast("bigint")).otherwise(h)


def fingerprint(payload_type: Column | str, prompt: Column | str, summary: Column | str, fallback: Column | None = None, separator: str = "|", raw_type: bool = False) -> Column:
    """SHA-256 of type, prompt and summary in normal form. A null type is the fallback's, else "unknown"."""
    kind = F.col(payload_type) if isinstance(payload_type, str) else payload_type
    kind = F.coalesce(kind, fallback, F.lit("unknown")) if fallback is not None else F.coalesce(kind, F.lit("unknown"))
    return F.sha2(F.concat_ws(separator, kind if raw_type else F.lower(strip(kind)), normalize(prompt), normalize(summary)), 256)


def near_text(payload_type: Column | str, prompt: Column | str, summary: Column | str) -> Column:
    """Type, prompt and summary as one text in normal form."""
    return normalize(F.concat_ws(" ", _text(payload_type), _text(prompt), _text(summary)))


def phrase_hits(c: Column, phrases: tuple[str, ...]) -> Column:
    """Occurrences of all phrases as whole words, whatever the case; a place counts for every phrase it holds."""
    return sum((F.regexp_count(c, F.lit(r"(?iU)\b" + re.escape(p).replace(r"\ ", " ") + r"\b")) for p in phrases), F.lit(0))


def has_any(c: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the text holds one of the phrases, as any part of a word."""
    out = F.lit(False)
    for p in phrases:  # one by one, not in a lambda: the text is then evaluated once
        out = out | F.contains(c, F.lit(p))
    return out


def found_of(c: Column, phrases: tuple[str, ...], most: int | None = None) -> Column:
    """The phrases the text holds, in the order of the list."""
    got = F.array_compact(F.array(*(F.when(F.contains(c, F.lit(p)), F.lit(p)) for p in phrases)))
    return got if most is None else F.slice(got, 1, most)


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(_text(c), r"(?U)\s+"), lambda x: x != ""))


def numbered(c: Column) -> Column:
    return c.rlike(r"(?m)^\s*\d+[.)]\s")


def bulleted(c: Column) -> Column:
    return c.rlike(r"(?m)^\s*[-*•]\s")


def shorten(c: Column, n: int, inside: bool = False) -> Column:
    """At most n characters and "..." after them; inside: the dots count among the n."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3 if inside else n), F.lit("..."))).otherwise(c)


def markdown_cell(c: Column, n: int = 80) -> Column:
    """One line, pipes escaped, shortened: fit for a table cell."""
    return shorten(F.replace(F.regexp_replace(_text(c), r"\s+", " "), F.lit("|"), F.lit("\\|")), n)


def as_json(c: Column | str) -> Column:
    """The value of JSON text, null where it is none. Make it a column of its own before the functions below are applied,
    so that a record is parsed once."""
    return F.try_parse_json(c)


def steps_text(v: Column, key: str) -> Column:
    """The steps of a JSON value as one text: a string, a list of strings, or of objects with a description."""
    many = F.try_variant_get(v, f"$.{key}", "array<variant>")
    texts = F.transform(many, lambda s: F.coalesce(F.when(F.schema_of_variant(s) == "STRING", F.try_variant_get(s, "$", "string")), F.try_variant_get(s, "$.description", "string")))
    one = string_field(v, key)
    return F.coalesce(F.array_join(F.transform(F.filter(texts, lambda t: t.isNotNull()), plain), " "), F.when(one.isNotNull(), plain(one)), F.lit(""))


def string_field(v: Column, key: str) -> Column:
    """A string of a JSON value, null if it is no string."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def flat_text(v: Column) -> Column:
    """Summary, next steps and verification steps of a JSON value, in lower case, joined by blanks."""
    parts = [F.when(string_field(v, "summary").isNotNull(), plain(string_field(v, "summary"))), F.nullif(steps_text(v, "next_steps"), F.lit("")), F.nullif(steps_text(v, "verification_steps"), F.lit(""))]
    return F.concat_ws(" ", *parts)


def full_text(v: Column) -> Column:
    """The flat text and the uncertainty notes."""
    notes = string_field(v, "uncertainty_notes")
    return F.concat_ws(" ", flat_text(v), F.when(notes.isNotNull(), plain(notes)))


def from_template(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} replaced by columns; braces within the values are left as they are."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(_text(values[p]) if k % 2 and p in values else F.lit(p if not k % 2 else "{" + p + "}") for k, p in enumerate(parts)))


def chat_text(messages: Column) -> Column:
    """Messages (role, content) as "<|role|>" lines with their contents."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n")
