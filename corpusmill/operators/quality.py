"""Quality filters, gates and failure tags, as columns over a JSON response (text.as_json)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed, text


def length_reason(flat: Column, least: int = 60, most: int = 1200) -> Column:
    """too_short or too_long by words; null passes."""
    n = text.word_count(flat)
    return F.when(n < least, F.lit("too_short")).when(n > most, F.lit("too_long"))


def vagueness_reason(flat: Column, vague: int = 2, concrete: int = 3, phrases=fixed.VAGUE_PHRASES, verbs=fixed.ACTION_VERBS) -> Column:
    """vague_low_specificity: many vague phrases, few action verbs and no list structure."""
    bad = (text.phrase_hits(flat, phrases) >= vague) & (text.phrase_hits(flat, verbs) < concrete) & ~text.numbered(flat) & ~text.bulleted(flat)
    return F.when(bad, F.lit("vague_low_specificity"))


def has_steps(v: Column, key: str = "verification_steps") -> Column:
    """Whether a list of steps isn't empty, or a string of them isn't blank."""
    many = F.size(F.try_variant_get(v, f"$.{key}", "array<variant>"))
    one = text.string_field(v, key)
    return F.coalesce(many > 0, F.lit(False)) | F.coalesce(text.strip(one) != "", F.lit(False))


def has_notes(v: Column) -> Column:
    return F.coalesce(text.strip(text.string_field(v, "uncertainty_notes")) != "", F.lit(False))


def overclaim_reason(full: Column, safeguarded: Column, markers=fixed.TIME_SENSITIVE_MARKERS, certain=fixed.STRONG_CERTAINTY_PHRASES) -> Column:
    """overconfident_time_sensitive: time-sensitive and certain, and without any safeguard."""
    return F.when((text.phrase_hits(full, markers) > 0) & (text.phrase_hits(full, certain) > 0) & ~safeguarded, F.lit("overconfident_time_sensitive"))


def filter_chain(records: DataFrame, response: str = "response", least: int = 60, most: int = 1200) -> DataFrame:
    """The records with reason: that of the first filter that fails (length, vagueness, overclaim), null if none does.
    A null or broken response counts as empty text."""
    v = F.col("_v")
    got = records.withColumn("_v", text.as_json(response)).withColumns({"_flat": text.flat_text(v), "_full": text.full_text(v), "_safe": has_steps(v) | has_notes(v)})
    reason = F.coalesce(length_reason(F.col("_flat"), least, most), vagueness_reason(F.col("_flat")), overclaim_reason(F.col("_full"), F.col("_safe")))
    return got.withColumn("reason", reason).drop("_v", "_flat", "_full", "_safe")


def parted(records: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by whether there is a reason."""
    return records.where(F.col(reason).isNull()), records.where(F.col(reason).isNotNull())


def contract_gate(envelope_ok: Column, payload_ok: Column) -> Column:
    code = F.when(~F.coalesce(envelope_ok, F.lit(False)), F.lit("envelope_invalid")).when(~F.coalesce(payload_ok, F.lit(False)), F.lit("payload_invalid")).otherwise(F.lit("ok"))
    return F.struct((code == "ok").alias("passed"), code.alias("reason_code"))


def overconfident(low: Column, phrases=fixed.GATE_OVERCONFIDENT, allowed=fixed.ALWAYS_ALLOWED) -> Column:
    """Whether lower-case text is certain; "always" is no certainty where it urges to check."""
    masked = low
    for a in allowed:
        masked = F.replace(masked, F.lit(a), F.lit(" " * len(a)))
    return text.has_any(low, tuple(p for p in phrases if p != "always")) | (F.contains(masked, F.lit("always")) if "always" in phrases else F.lit(False))


def verification_gate(hot: Column, steps: Column, notes: Column) -> Column:
    """Time-sensitive text needs verification steps and notes."""
    missing = F.array_compact(F.array(F.when(~steps, F.lit("verification_steps")), F.when(~notes, F.lit("uncertainty_notes"))))
    passed = ~hot | (steps & notes)
    return F.struct(passed.alias("passed"), F.when(passed, F.lit("ok")).otherwise(F.lit("missing_verification_requirements")).alias("reason_code"), missing.alias("missing"))


def overconfidence_gate(hot: Column, sure: Column) -> Column:
    """Time-sensitive text must not be certain."""
    passed = ~hot | ~sure
    return F.struct(passed.alias("passed"), F.when(passed, F.lit("ok")).otherwise(F.lit("overconfident_time_sensitive")).alias("reason_code"))


def with_gates(records: DataFrame, raw: Column, envelope_ok: Column, payload_ok: Column, steps: Column, notes: Column, keywords=fixed.GATE_KEYWORDS) -> DataFrame:
    """The records with gates (contract, verification, overconfidence) and keywords (the first three that make the text
    time-sensitive, in the order of the list). The second and third gate are skipped (not passed) where the contract
    failed. What the gates share is made a column first, so it is evaluated once."""
    got = records.withColumns({"_low": F.lower(F.coalesce(raw, F.lit(""))), "_steps": steps, "_notes": notes})
    got = got.withColumns({"_hot": text.has_any(F.col("_low"), keywords), "_sure": overconfident(F.col("_low")), "keywords": text.found_of(F.col("_low"), keywords, 3)})
    skipped = F.struct(F.lit(False).alias("passed"), F.lit("skipped_contract_failed").alias("reason_code"))
    ok = F.coalesce(envelope_ok & payload_ok, F.lit(False))
    short = lambda g: F.struct(g["passed"].alias("passed"), g["reason_code"].alias("reason_code"))
    second, third = verification_gate(F.col("_hot"), F.col("_steps"), F.col("_notes")), overconfidence_gate(F.col("_hot"), F.col("_sure"))
    gates = F.struct(contract_gate(envelope_ok, payload_ok).alias("contract"), F.when(ok, short(second)).otherwise(skipped).alias("verification"), F.when(ok, third).otherwise(skipped).alias("overconfidence"))
    return got.withColumn("gates", gates).drop("_low", "_steps", "_notes", "_hot", "_sure")


def gate_names() -> tuple[str, ...]:
    return ("contract", "verification", "overconfidence")


def overall(g: Column) -> Column:
    """Whether all gates passed."""
    return g["contract"]["passed"] & g["verification"]["passed"] & g["overconfidence"]["passed"]


def failed_codes(g: Column) -> Column:
    """Reason codes of the gates that failed, in order."""
    return F.array_compact(F.array(*(F.when(~g[n]["passed"], g[n]["reason_code"]) for n in gate_names())))


def failure_tags(v: Column, certain=fixed.TAG_OVERCONFIDENT, generic=fixed.TAG_GENERIC_STEPS) -> Column:
    """The tags of a JSON value, in a fixed order; none where it is no object."""
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    steps, nexts = has_steps(v, "verification_steps"), has_steps(v, "next_steps")
    listed = F.try_variant_get(v, "$.verification_steps", "array<variant>")
    words = F.transform(F.filter(listed, lambda s: F.schema_of_variant(s) == "STRING"), lambda s: F.lower(F.try_variant_get(s, "$", "string")))
    words = F.filter(words, lambda s: text.strip(s) != "")
    said = F.lower(F.concat_ws(" ", F.coalesce(text.strip(text.string_field(v, "summary")), F.lit("")), F.coalesce(text.strip(text.string_field(v, "uncertainty_notes")), F.lit(""))))
    only_generic = F.coalesce((F.size(words) > 0) & F.forall(words, lambda s: s.rlike("|".join(generic))), F.lit(False))
    tags = F.array(
        F.when(~steps, F.lit("missing_verification_steps")), F.when(~nexts, F.lit("missing_next_steps")),
        F.when(text.has_any(said, certain) & ~F.coalesce(F.size(listed) > 0, F.lit(False)), F.lit("overconfident_no_verification")), F.when(only_generic, F.lit("generic_verification_only")),
    )
    return F.when(whole, F.array_compact(tags)).otherwise(F.array().cast("array<string>"))


def stricter_reason(v: Column, modes: tuple[str, ...]) -> Column:
    """Why a record fails the rules that go with the targeted failure modes; null if it doesn't."""
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    listed = F.try_variant_get(v, "$.verification_steps", "array<variant>")
    joined = F.lower(F.array_join(F.transform(F.filter(listed, lambda s: F.schema_of_variant(s) == "STRING"), lambda s: F.try_variant_get(s, "$", "string")), " "))
    out = F.when(~whole, F.lit("response_invalid"))
    if "missing_verification_steps" in modes:
        out = out.when(~has_steps(v, "verification_steps"), F.lit("verification_steps_empty"))
        out = out.when((F.contains(joined, F.lit("check online")) | F.contains(joined, F.lit("verify online"))) & (F.size(listed) <= 1), F.lit("verification_steps_generic_only"))
    if "missing_verification_steps" in modes or "missing_next_steps" in modes:
        out = out.when(~has_notes(v), F.lit("uncertainty_notes_empty"))
    return out


def tagged_with(records: DataFrame, tags: Column, modes: tuple[str, ...]) -> DataFrame:
    """Records that have one of the modes among their tags."""
    return records.where(F.arrays_overlap(tags, F.array(*map(F.lit, modes))))


def markers(c: Column) -> Column:
    """Whether a text holds assumption markers, verification markers and clarifying questions."""
    low = F.lower(F.coalesce(c, F.lit("")))
    one = lambda patterns: low.rlike("|".join(f"(?:{p})" for p in patterns))
    return F.struct(one(fixed.ASSUMPTION_PATTERNS).alias("has_assumptions_marker"), one(fixed.VERIFICATION_PATTERNS).alias("has_verification_marker"), one(fixed.CLARIFYING_PATTERNS).alias("has_clarifying_questions"))


def marker_contexts(c: Column, patterns: tuple[str, ...], most: int = 3, around: int = 10) -> Column:
    """The first places of the patterns with what stands around them."""
    low = F.lower(F.coalesce(c, F.lit("")))
    found = F.flatten(F.array(*(F.regexp_extract_all(low, F.lit(rf"(.{{0,{around}}}(?:{p}).{{0,{around}}})"), 1) for p in patterns)))
    return F.slice(found, 1, most)


def rate_gate(records: DataFrame, valid: Column, threshold: float = 0.85) -> DataFrame:
    """One row: total, valid, rate and whether the rate reaches the threshold (no records: it doesn't)."""
    agg = records.agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"))
    rate = F.coalesce(F.try_divide("valid", "total"), F.lit(0.0))
    return agg.select("total", "valid", rate.alias("valid_rate"), (rate >= threshold).alias("passed"))


def only_reason(rejects: DataFrame, codes: str, code: str) -> DataFrame:
    """Rejects whose codes are exactly one."""
    return rejects.where(F.col(codes) == F.array(F.lit(code)))
