"""Queries of the corpus operators over the driver's tables, with the same results in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import fixed, jsonx, text
from corpusmill.operators import balance, dedup, evaluation, joins, plan, quality, records, sft, split, stats
from corpusmill.session import new_path, staged
from corpusmill.sources import jsonl

# Shared SQL ----------------------------------------------------------------------------------------------------------

WS = r"[\t-\r \x{85}\p{Z}]"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _sql_norm(x: str) -> str:
    return f"lower({_sql_strip(f"regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g')")})"


def _sql_tokens(x: str, lower: bool = False) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '[[:punct:]]', '', 'g')"
    return f"list_filter(regexp_split_to_array({f'lower({t})' if lower else t}, '{WS}+'), lambda x: x <> '')"


_SQL_SH = "case when len(w) >= 3 then list_distinct(list_transform(range(0, len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' '))) else [] end"
_SQL_FP = f"sha256(lower({_sql_strip("coalesce(payload_type, 'unknown')")}) || '|' || {_sql_norm('prompt')} || '|' || {_sql_norm('summary')})"
_SQL_MD5 = "(('0x' || md5(list_min(sh))[1:16])::ubigint % 1000 * 616 + ('0x' || md5(list_min(sh))[17:32])::ubigint % 1000) % 1000"
_SQL_SHA = "(((('0x' || sha256(list_min(sh))[1:16])::ubigint % 1000 * 616 + ('0x' || sha256(list_min(sh))[17:32])::ubigint % 1000) % 1000 * 616 + ('0x' || sha256(list_min(sh))[33:48])::ubigint % 1000) % 1000 * 616 + ('0x' || sha256(list_min(sh))[49:64])::ubigint % 1000) % 1000"
_SQL_J = "len(list_intersect(a.sh, b.sh))::double / (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh)))"


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _records(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return _read(spark, d, "dataset_v1").select("id", "ord", *cols)


# Text and keys -------------------------------------------------------------------------------------------------------


def normalize(spark, d):
    return _records(spark, d, "prompt").select("id", text.normalize("prompt").alias("prompt"))


def tokens(spark, d):
    return _records(spark, d, "prompt").select("id", F.array_join(text.tokens("prompt"), " ").alias("tokens"))


def shingle_counts(spark, d):
    return dedup.shingled(_records(spark, d, "prompt"), text.tokens("prompt")).select("id", F.size("sh").cast("long").alias("shingles"))


def bucket_id(spark, d):
    sh = dedup.shingled(_records(spark, d, "prompt"), text.tokens("prompt"))
    sha = dedup.shingled(_records(spark, d, "prompt"), text.tokens("prompt"), digest="sha256").select("id", F.col("bucket").alias("bucket_sha"))
    return sh.select("id", F.col("bucket").alias("bucket_md5")).join(sha, "id")


def _fingerprint():
    return text.fingerprint("payload_type", "prompt", "summary")


def fingerprint(spark, d):
    return _records(spark, d, "payload_type", "prompt", "summary").select("id", _fingerprint().alias("fingerprint"))


# Duplicates ----------------------------------------------------------------------------------------------------------


def exact_dedup(spark, d):
    return dedup.exact_dedup(_records(spark, d, "payload_type", "prompt", "summary"), _fingerprint()).select("id", "anchor_id", "reason")


def dup_examples(spark, d):
    return dedup.duplicate_examples(dedup.exact_dedup(_records(spark, d, "payload_type", "prompt", "summary"), _fingerprint()))


def _near_words():
    return text.tokens(text.near_text("payload_type", "prompt", "summary"))


def near_dup_pairs(spark, d):
    return dedup.near_pairs(_records(spark, d, "payload_type", "prompt", "summary"), _near_words())[0]


def near_dup_members(spark, d):
    return dedup.near_pairs(_records(spark, d, "payload_type", "prompt", "summary"), _near_words())[1]


def near_dup_greedy(spark, d):
    return dedup.near_dedup(_records(spark, d, "payload_type", "prompt", "summary"), _near_words())


def _groups(spark, d):
    return dedup.leakage_groups(_records(spark, d, "payload_type", "prompt", "summary"), _fingerprint(), _near_words())


def leakage_components(spark, d):
    return _groups(spark, d)


def group_stats(spark, d):
    return split.group_stats(staged(_groups(spark, d), "groups"))


_SQL_SETS = f"r as (select id, ord, {_SQL_FP} fp, {_sql_tokens(_sql_norm("coalesce(payload_type, '') || ' ' || coalesce(prompt, '') || ' ' || coalesce(summary, '')"))} w from dataset_v1), s as (select id, ord, fp, {_SQL_SH} sh from r), t as (select *, case when len(sh) = 0 then 0 else {_SQL_SHA} end bucket, array_to_string(list_sort(sh), chr(10)) k from s), reps as (select min(ord) ord, arg_min(id, ord) id, any_value(sh) sh, any_value(bucket) bucket, k from t group by k), pairs as (select a.id id_a, b.id id_b, {_SQL_J} sim from reps a join reps b on a.bucket = b.bucket and a.ord < b.ord where len(a.sh) > 0 and len(b.sh) > 0 and {_SQL_J} >= 0.75)"
_SQL_GROUPS = f"with recursive {_SQL_SETS}, firsts as (select fp, min(id) f from t group by fp), e0 as (select f a, id b from t join firsts using (fp) union select id_a, id_b from pairs union select reps.id, t.id from t join reps using (k)), e as (select a, b from e0 union select b, a from e0), reach(id, r) as (select id, id from t union select e.b, reach.r from reach join e on e.a = reach.id), g as (select id, min(r) group_id from reach group by id)"


# Quality -------------------------------------------------------------------------------------------------------------


def _quality(spark, d):
    return _records(spark, d, "response", "quality_ok").withColumn("v", text.as_json("response"))


def flat_text(spark, d):
    v = F.col("v")
    return _quality(spark, d).select("id", text.flat_text(v).alias("flat"), text.full_text(v).alias("full_text"))


def length_filter(spark, d):
    return _quality(spark, d).withColumn("flat", text.flat_text(F.col("v"))).select("id", quality.length_reason(F.col("flat")).alias("reason"))


FREQUENT = ("the", "on", "en")


def phrase_filter(spark, d):
    flat = F.col("flat")
    return _quality(spark, d).withColumn("flat", text.flat_text(F.col("v"))).select("id", text.phrase_hits(flat, fixed.VAGUE_PHRASES + FREQUENT).cast("long").alias("vague"), text.phrase_hits(flat, fixed.ACTION_VERBS).cast("long").alias("concrete"), text.numbered(flat).alias("numbered"), quality.vagueness_reason(flat, phrases=FREQUENT, concrete=5).alias("reason"))


def overclaim_filter(spark, d):
    full, safe = F.col("full"), quality.has_steps(F.col("v")) | quality.has_notes(F.col("v"))
    return _quality(spark, d).withColumn("full", text.full_text(F.col("v"))).select("id", safe.alias("safeguarded"), quality.overclaim_reason(full, F.lit(False), markers=fixed.TIME_SENSITIVE_MARKERS + ("hours",), certain=fixed.STRONG_CERTAINTY_PHRASES + ("the",)).alias("reason"))


def filter_chain(spark, d):
    return quality.filter_chain(_quality(spark, d)).select("id", "reason")


def reject_histogram(spark, d):
    return stats.reasons(quality.filter_chain(_quality(spark, d)))


def gate_reasons(spark, d):
    ok, v = F.col("quality_ok"), F.col("v")
    out = quality.with_gates(_quality(spark, d), F.col("response"), ok, ok, quality.has_steps(v), quality.has_notes(v))
    return out.select("id", quality.overall(F.col("gates")).alias("passed"), F.array_join(quality.failed_codes(F.col("gates")), ",").alias("reasons"))


def failure_tags(spark, d):
    return _quality(spark, d).select("id", F.array_join(quality.failure_tags(F.col("v")), ",").alias("tags"))


def stricter_reasons(spark, d):
    return _quality(spark, d).select("id", quality.stricter_reason(F.col("v"), ("missing_verification_steps", "missing_next_steps")).alias("reason"))


def uncertainty_flags(spark, d):
    m = quality.markers(F.col("output_text"))
    return _read(spark, d, "drafts_v1").select("id", *(m[c].alias(c) for c in ("has_assumptions_marker", "has_verification_marker", "has_clarifying_questions"))).distinct()


def valid_rate(spark, d):
    return quality.rate_gate(_quality(spark, d), F.coalesce("quality_ok", F.lit(False)))


def _sql_steps(key: str) -> str:
    part = f"list_filter(list_transform(json_extract(v, '$.{key}[*]'), lambda s: case json_type(s) when 'VARCHAR' then s ->> '$' when 'OBJECT' then s ->> '$.description' end), lambda s: s is not null)"
    return f"case when json_type(v, '$.{key}') = 'ARRAY' then nullif(array_to_string(list_transform({part}, lambda s: {_sql_strip('lower(s)')}), ' '), '') when json_type(v, '$.{key}') = 'VARCHAR' then nullif({_sql_strip(f"lower(v ->> '$.{key}')")}, '') end"


def _sql_string(key: str) -> str:
    return f"case when json_type(v, '$.{key}') = 'VARCHAR' then v ->> '$.{key}' end"


def _sql_has_steps(key: str) -> str:
    return f"(coalesce(json_type(v, '$.{key}') = 'ARRAY' and json_array_length(v, '$.{key}') > 0, false) or coalesce({_sql_strip(_sql_string(key))} <> '', false))"


def _sql_hits(c: str, phrases) -> str:
    return " + ".join(f"len(regexp_extract_all({c}, '(?i)\\b{p}\\b'))" for p in phrases)


_SQL_NOTES = f"coalesce({_sql_strip(_sql_string('uncertainty_notes'))} <> '', false)"
_SQL_RESP = f"with v as (select id, ord, quality_ok, response, case when json_valid(response) then response::json end v from dataset_v1), f as (select *, concat_ws(' ', {_sql_strip(f"lower({_sql_string('summary')})")}, {_sql_steps('next_steps')}, {_sql_steps('verification_steps')}) flat, {_sql_has_steps('verification_steps')} steps, {_SQL_NOTES} notes from v), q as (select *, concat_ws(' ', flat, {_sql_strip(f"lower({_sql_string('uncertainty_notes')})")}) full_text, len(list_filter(regexp_split_to_array(flat, '{WS}+'), lambda x: x <> '')) n from f)"
_SQL_LEN = "case when n < 60 then 'too_short' when n > 1200 then 'too_long' end"
_SQL_LIST = r"(regexp_matches(flat, '(?m)^\s*\d+[.)]\s') or regexp_matches(flat, '(?m)^\s*[-*•]\s'))"


def _sql_vague(phrases, concrete: int) -> str:
    return f"case when {_sql_hits('flat', phrases)} >= 2 and {_sql_hits('flat', fixed.ACTION_VERBS)} < {concrete} and not {_SQL_LIST} then 'vague_low_specificity' end"


def _sql_over(markers, certain, safe: str) -> str:
    return f"case when {_sql_hits('full_text', markers)} > 0 and {_sql_hits('full_text', certain)} > 0 and not {safe} then 'overconfident_time_sensitive' end"


def _sql_any(c: str, phrases) -> str:
    return "(" + " or ".join(f"contains({c}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


_SQL_CHAIN = f"coalesce({_SQL_LEN}, {_sql_vague(fixed.VAGUE_PHRASES, 3)}, {_sql_over(fixed.TIME_SENSITIVE_MARKERS, fixed.STRONG_CERTAINTY_PHRASES, '(steps or notes)')})"
_MASKED = "low"
for _a in fixed.ALWAYS_ALLOWED:
    _MASKED = f"replace({_MASKED}, '{_a}', '{' ' * len(_a)}')"
_SQL_GATES = f"{_SQL_RESP}, l as (select *, lower(coalesce(response, '')) low from q), g as (select id, coalesce(quality_ok, false) ok, {_sql_any('low', fixed.GATE_KEYWORDS)} hot, steps, notes, {_sql_any('low', [p for p in fixed.GATE_OVERCONFIDENT if p != 'always'])} or contains({_MASKED}, 'always') sure from l) select id, ok and (not hot or (steps and notes)) and (not hot or not sure) passed, case when not ok then 'envelope_invalid,skipped_contract_failed,skipped_contract_failed' else concat_ws(',', case when hot and not (steps and notes) then 'missing_verification_requirements' end, case when hot and sure then 'overconfident_time_sensitive' end) end reasons from g"
_SQL_ONLY = "list_filter(list_transform(list_filter(json_extract(v, '$.verification_steps[*]'), lambda s: json_type(s) = 'VARCHAR'), lambda s: lower(s ->> '$')), lambda s: regexp_replace(s, '\\s', '', 'g') <> '')"
_SQL_SAID = f"lower(coalesce({_sql_strip(_sql_string('summary'))}, '') || ' ' || coalesce({_sql_strip(_sql_string('uncertainty_notes'))}, ''))"
_SQL_TAGS = f"{_SQL_RESP} select id, case when json_type(v) = 'OBJECT' then concat_ws(',', case when not steps then 'missing_verification_steps' end, case when not {_sql_has_steps('next_steps')} then 'missing_next_steps' end, case when {_sql_any(_SQL_SAID, fixed.TAG_OVERCONFIDENT)} and not coalesce(json_array_length(v, '$.verification_steps') > 0, false) then 'overconfident_no_verification' end, case when json_type(v, '$.verification_steps') = 'ARRAY' and len({_SQL_ONLY}) > 0 and len(list_filter({_SQL_ONLY}, lambda s: not regexp_matches(s, '{'|'.join(fixed.TAG_GENERIC_STEPS)}'))) = 0 then 'generic_verification_only' end) else '' end tags from q"


# Balance and samples -------------------------------------------------------------------------------------------------

_DIMS = ("category", "difficulty", "payload_type", "region_tags")
_SQL_KEYS = "coalesce(category, 'unknown') category, coalesce(difficulty, 'medium') difficulty, coalesce(payload_type, 'unknown') payload_type"
_SQL_CAPS = f"with b as (select {_SQL_KEYS}, count(*) n from dataset_v1 group by all), m as (select list_sort(list(n))[count(*) // 2 + 1] median from b), c as (select b.*, median, greatest(1, floor(median * case when difficulty = 'hard' then 3.0 else 2.0 end))::bigint cap from b, m)"


def bucket_stats(spark, d):
    return balance.bucket_stats(_records(spark, d, *_DIMS))


def target_caps(spark, d):
    return balance.target_caps(balance.bucket_stats(_records(spark, d, *_DIMS)))


def downsample(spark, d):
    rows = _records(spark, d, *_DIMS)
    return balance.downsample(rows, balance.target_caps(balance.bucket_stats(rows))).select("id", "reason")


def balance_stats(spark, d):
    rows = _records(spark, d, *_DIMS)
    caps = balance.target_caps(balance.bucket_stats(rows))
    return balance.balance_stats(rows, balance.downsample(rows, caps), caps)


def top_removed_buckets(spark, d):
    return stats.top_removed(balance_stats(spark, d)).select("category", "difficulty", "payload_type", "removed")


def spotcheck_sample(spark, d):
    return balance.sample(_records(spark, d), 30).select("id")


def stratified_sample(spark, d):
    return balance.round_robin(_records(spark, d, *_DIMS), ["payload_type", "difficulty"], 40).select("id")


def _tagged(spark, d):
    return _quality(spark, d).select("id", "ord", quality.failure_tags(F.col("v")).alias("tags"))


def oversample(spark, d):
    return balance.oversample_matches(_tagged(spark, d), F.col("tags"), ("missing_verification_steps", "missing_next_steps"), 1.5).select("id", "source_id")


# Statistics ----------------------------------------------------------------------------------------------------------

_SQL_DIST = "with x as (select ord, unnest([{'d': 'category', 'v': coalesce(category, 'unknown')}, {'d': 'difficulty', 'v': coalesce(difficulty, 'unknown')}, {'d': 'payload_type', 'v': coalesce(payload_type, 'unknown')}] || list_transform(coalesce(region_tags, []), lambda t: {'d': 'region_tag', 'v': coalesce(t, 'unknown')})) s from dataset_v1), dist as (select s.d dim_name, s.v \"value\", count(*) n, min(ord) first_ord from x group by all)"


def distribution(spark, d):
    return stats.distributions(_records(spark, d, *_DIMS))


def percentages(spark, d):
    rows = _records(spark, d, *_DIMS)
    return stats.percentages(stats.distributions(rows), rows.count())


def coverage(spark, d):
    return stats.coverage(stats.distributions(_records(spark, d, *_DIMS)))


def drift(spark, d):
    spec = _read(spark, d, "target_mix").where("dim_name = 'category'").select(F.col("dim_value").alias("value"), F.round(F.col("target_share") * 100).cast("long").alias("intended"))
    return stats.drift(stats.distributions(_records(spark, d, *_DIMS)), spec)


def top_tags(spark, d):
    return stats.top(stats.distributions(_records(spark, d, *_DIMS)), "region_tag")


def top_error_codes(spark, d):
    return stats.top_codes(_read(spark, d, "drafts_v1").select(F.col("contract.error_code").alias("error_code")), "error_code")


def plan_stats(spark, d):
    return plan.plan_stats(_read(spark, d, "drafts_v1").select("prompt_plan.*"))


# Splits --------------------------------------------------------------------------------------------------------------


def _members(spark, d):
    return split.membership(_read(spark, d, "split_rows"), _read(spark, d, "splits_manifest"))


_SQL_PATH = lambda c: f"regexp_replace(regexp_replace(regexp_replace(trim({c}), '[\\\\/]+', '/', 'g'), '/(\\./)+', '/', 'g'), '^(\\./)+', '')"
_SQL_MEMBERS = f"with p as (select split_version, 'train' split, {_SQL_PATH('outputs.train_path')} path from splits_manifest union all select split_version, 'val', {_SQL_PATH('outputs.val_path')} from splits_manifest union all select split_version, 'test', {_SQL_PATH('outputs.test_path')} from splits_manifest), m as (select distinct split_version, split, record_id id from split_rows join p on p.path = {_SQL_PATH('split_path')})"


def split_members(spark, d):
    return _members(spark, d).groupBy("split_version", "split").agg(F.count("*").alias("records"))


def split_validate(spark, d):
    """Of each version, the fingerprints that stand in several of its splits, beside what is claimed."""
    rows = _members(spark, d).join(_records(spark, d, "payload_type", "prompt", "summary").select("id", _fingerprint().alias("fingerprint")), "id")
    span = rows.groupBy("split_version", "fingerprint").agg(F.min("split").alias("a"), F.max("split").alias("b")).groupBy("split_version").agg(F.count_if(F.col("a") != F.col("b")).alias("spanning"))
    claim = _read(spark, d, "splits_stats").select("split_version", F.col("leakage_validation.fingerprints_spanning_splits").alias("claimed"))
    return claim.join(span, "split_version", "left").select("split_version", F.coalesce("spanning", F.lit(0)).alias("spanning"), "claimed")


def split_distribution(spark, d):
    return split.distributions(_members(spark, d).join(_records(spark, d, *_DIMS), "id"))


def heldout_projection(spark, d):
    rows = _members(spark, d).join(_records(spark, d, "prompt", *_DIMS), "id")
    return split.held_out(rows).select("id", "prompt", "payload_type", "category", "difficulty", F.array_join("region_tags", ",").alias("region_tags")).distinct()


def split_assign(spark, d):
    return split.assign(staged(_groups(spark, d), "groups")).select("id", "group_id", "split")


def split_assign_checked(spark, d):
    """One row: groups and fingerprints that the assignment leaves in several splits."""
    rows = split_assign(spark, d).join(_records(spark, d, "payload_type", "prompt", "summary").select("id", _fingerprint().alias("fingerprint")), "id")
    return split.validate(staged(rows, "assigned"))


# Joins ---------------------------------------------------------------------------------------------------------------


def _last_drafts(spark, d):
    return joins.last_of(_read(spark, d, "drafts_v1").select("id", "output_text", "ingested_at", F.col("contract.overall_ok").alias("overall_ok")), "id", "ingested_at")


def full_outer_join_inputs(spark, d):
    drafts = _last_drafts(spark, d)
    verdicts = drafts.where("overall_ok is not null").select(F.col("id").alias("draft_id"), F.when(F.col("overall_ok"), "accept").otherwise("reject").alias("verdict"))
    got = joins.reject_by_verdict(joins.join_inputs(_records(spark, d, "prompt"), drafts.select("id", "output_text"), verdicts), F.col("critique.verdict"))
    return got.select("id", F.array_join("missing_components", ",").alias("missing_components"), F.col("critique.verdict").alias("verdict"), "reason")


def run_counters(spark, d):
    return stats.run_counters(full_outer_join_inputs(spark, d))


def resume_anti_join(spark, d):
    drafts = _last_drafts(spark, d).withColumn("ord", F.lit(0))
    return joins.resume(drafts, _records(spark, d)).select("id")


# JSON and evaluation -------------------------------------------------------------------------------------------------


def _drafts(spark, d):
    return _read(spark, d, "drafts_v1").select("id", "output_text", F.col("prompt_plan.payload_type").alias("suite"), F.col("teacher.selected_model").alias("model"), F.col("teacher.latency_s").alias("latency_s"), F.col("teacher.total_tokens").alias("tokens"), F.col("contract.overall_ok").alias("overall_ok"))


def strict_json(spark, d):
    return _drafts(spark, d).select("id", jsonx.is_strict(F.coalesce("output_text", F.lit(""))).alias("strict_json_ok")).distinct()


def lenient_json(spark, d):
    return jsonx.parsed(_drafts(spark, d), "output_text", ["id"]).select("id", "strict_json_ok", "lenient_json_ok", "is_object", "payload_type").distinct()


def contract(spark, d):
    got = jsonx.contract_flags(jsonx.parsed(_drafts(spark, d), "output_text", ["id"]))
    return got.select("id", "strict_json_ok", "lenient_json_ok", "envelope_ok", "payload_ok", "overall_ok", "error_code", "failed_at", "rule").distinct()


def required_fields(spark, d):
    got = jsonx.parsed(_records(spark, d, "response"), "response", ["id"])
    return got.where("strict_json_ok and is_object").select("id", F.array_join("missing", ",").alias("missing"))


def canonical_json(spark, d):
    return _records(spark, d, "response").where(F.get_json_object("response", "$.payload_type").isNotNull()).select("id", jsonx.preview(F.col("response")).alias("keys"))


def _eval_rows(spark, d):
    m = quality.markers(F.col("output_text"))
    rows = _drafts(spark, d).withColumns({c: m[c] for c in ("has_assumptions_marker", "has_verification_marker", "has_clarifying_questions")})
    ok = jsonx.is_strict(F.coalesce("output_text", F.lit("")))
    return rows.withColumns({"strict_json_ok": ok, "lenient_json_ok": ok | F.contains("output_text", F.lit("{")), "envelope_ok": F.col("overall_ok"), "payload_ok": F.col("overall_ok"), "required_fields_ok": F.when(ok, F.col("overall_ok")), "tokens_per_s": F.try_divide("tokens", "latency_s")})


_SQL_M = {c: "|".join(f"(?:{p})" for p in ps) for c, ps in (("has_assumptions_marker", fixed.ASSUMPTION_PATTERNS), ("has_verification_marker", fixed.VERIFICATION_PATTERNS), ("has_clarifying_questions", fixed.CLARIFYING_PATTERNS))}
_SQL_MARKS = ", ".join(f"regexp_matches(lower(coalesce(output_text, '')), '{p}') {c}" for c, p in _SQL_M.items())
# DuckDB takes JSON with a comma before a closing bracket for valid.
_SQL_STRICT = r"coalesce(json_valid(output_text) and not regexp_matches(output_text, ',\s*[}\]]'), false)"
_SQL_EVAL = f"with e as (select id, prompt_plan.payload_type suite, teacher.selected_model model, teacher.latency_s latency_s, case when teacher.latency_s <> 0 then teacher.total_tokens / teacher.latency_s end tps, contract.overall_ok overall_ok, {_SQL_MARKS}, {_SQL_STRICT} strict, coalesce(contains(output_text, '{{'), false) braces from drafts_v1)"


def eval_rollup(spark, d):
    got = evaluation.rollup(_eval_rows(spark, d))
    r = lambda c: F.round(c, 6).alias(c)
    return got.select("suite", "is_total", "n", r("strict_json_parse_rate"), r("lenient_json_parse_rate"), r("assumptions_marker_rate"), r("verification_marker_rate"), r("clarifying_questions_rate"), r("overall_contract_pass_rate"), r("required_fields_rate"), "n_with_required_fields", r("avg_latency_s"), r("p50_latency_s"), r("p90_latency_s"), r("avg_tokens_per_s"), r("p50_tokens_per_s"))


def latency_percentiles(spark, d):
    got = evaluation.latency_stats(_drafts(spark, d).where("latency_s is not null"), "latency_s")
    return got.select("n", *(F.round(c, 6).alias(c) for c in ("avg", "p50", "p90", "least", "largest")))


def _sample_rows(spark, d):
    return _eval_rows(spark, d).select("id", "model", F.col("strict_json_ok").alias("parse_success"), F.coalesce("overall_ok", F.lit(False)).alias("schema_valid"), F.when(F.coalesce("overall_ok", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("verification_steps"))).alias("missing_fields"), F.col("has_verification_marker").alias("uncertainty_marker_present"), (F.col("latency_s") * 1000).alias("latency_ms"), F.when(~F.col("strict_json_ok"), "JSON_STRICT_PARSE_FAILED").when(~F.coalesce("overall_ok", F.lit(False)), "ENVELOPE_SCHEMA_FAILED").alias("error_code"))


def metric_delta(spark, d):
    got = evaluation.metric_delta(evaluation.run_metrics(_sample_rows(spark, d)), "lantern/guide-8b", "lantern/guide-70b")
    return got.select("metric", F.round("base", 6).alias("base"), F.round("tuned", 6).alias("tuned"), F.when(F.col("metric").startswith("avg_"), F.round(F.round("tuned", 6) - F.round("base", 6), 2)).otherwise(F.round(F.round("tuned", 6) - F.round("base", 6), 4)).alias("delta"))


def severity_topk(spark, d):
    return evaluation.curated(_once(_eval_rows(spark, d))).select("id", "score")


def _once(rows):
    """One row an id: the flags are those of the least of its repeated rows."""
    cols = ["suite", "strict_json_ok", "required_fields_ok", "has_verification_marker", "has_assumptions_marker", "latency_s"]
    return rows.groupBy("id").agg(F.min(F.struct(*cols)).alias("r")).select("id", "r.*")


def taxonomy(spark, d):
    return evaluation.taxonomy(_sample_rows(spark, d))


def failure_categories(spark, d):
    rows = _once(_eval_rows(spark, d)).where("not strict_json_ok or not coalesce(required_fields_ok, true)")
    return rows.groupBy(evaluation.category(suites=("itinerary",)).alias("category")).agg(F.count("*").alias("n"))


# Export, sources -----------------------------------------------------------------------------------------------------


def sft_rows(spark, d):
    rows = _records(spark, d, "prompt", "response", *_DIMS)
    got = sft.chat_rows(rows, "train")
    return got.select("id", text.chat_text(F.col("messages")).alias("chat"), "target", F.col("metadata.payload_type").alias("payload_type"))


def sft_errors(spark, d):
    rows = _records(spark, d, "response", "payload_type")
    return sft.targets(rows).where("sft_error is not null").select("id", "sft_error")


def jsonl_round_trip(spark, d):
    """The records written as JSON lines and scanned again."""
    rows = _records(spark, d, "prompt", "summary", *_DIMS)
    path = new_path(spark, "jsonl")
    jsonl.write(rows, path, order=["ord"])
    back, _ = jsonl.scan(spark, path, rows.schema, required=("id", "prompt"))
    return back.select("id", "ord", "prompt", "summary", "category", F.array_join("region_tags", ",").alias("region_tags"))


def jsonl_skip(spark, d):
    """Drafts as lines of a file: those that are JSON objects with a summary, and why the others are rejected."""
    path = new_path(spark, "lines")
    _read(spark, d, "dataset_v1").select(F.regexp_replace(F.coalesce("response", F.lit("")), r"[\r\n]+", " ").alias("value")).write.text(path)
    good, bad = jsonl.scan(spark, path, "summary string", bad="skip", required=("summary",))
    return good.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def v2_union(spark, d):
    """Base records and draws from those with failure tags, by source."""
    rows = _tagged(spark, d)
    base = sft.traced(rows)
    more = balance.oversample_matches(rows, F.col("tags"), ("missing_verification_steps", "missing_next_steps"), 1.5).withColumn("source", F.lit("oversampled"))
    return joins.union_all(base, more).groupBy("source").agg(F.count("*").alias("n"))


def pass_rates(spark, d):
    got = records.pass_rates(jsonx.contract_flags(jsonx.parsed(_drafts(spark, d), "output_text", ["id"])))
    return got.select("attempted", F.round("strict_json_ok_rate", 6).alias("strict_json_ok_rate"))


def error_envelopes(spark, d):
    rows = _read(spark, d, "drafts_v1").where("contract.error_code is not null").withColumn("e", records.error_envelope(F.col("contract.error_code"), F.lit("$"), F.col("output_text")))
    return rows.select("id", "e.error_code", F.element_at("e.guidance", 1).alias("guidance"), F.length("e.excerpt").cast("long").alias("excerpt_length")).distinct()


def dry_run_contract(spark, d):
    """Contracts of dry-run answers to the records."""
    rows = records.dry_run(_records(spark, d, "payload_type"))
    got = jsonx.contract_flags(jsonx.parsed(rows, "output_text", ["id"]))
    return got.groupBy(F.coalesce("error_code", F.lit("ok")).alias("code")).agg(F.count("*").alias("n"))


SPEC = {
    "seed": 42, "total_examples": 2000, "payload_types": {"itinerary": 0.4, "checklist": 0.3, "procedure": 0.2, "decision_tree": 0.1}, "categories": {"transport": 0.5, "safety": 0.3, "health": 0.2}, "difficulties": {"easy": 0.3, "medium": 0.5, "hard": 0.2},
    "regions": {"north": 0.6, "south": 0.4}, "locations": {"north": [("Vinlo", ["Tinska", "Mivik"]), ("Elrune", ["Novik"])], "south": [("Solta", ["Isthos", "Duwen", "Corta"])]}, "user_profiles": ["a choir on tour", "a solo cyclist"],
    "contexts": {"budget": (0.7, ["tight", "moderate"]), "season": (0.6, ["early spring", "late winter"])}, "templates": {k: f"Write a {k.replace('_', ' ')} for {{user_profile}} in {{city}}, {{country}}: {{category}}, {{trip_context}}." for k in fixed.PAYLOAD_TYPES},
}


def prompt_plan(spark, d):
    return plan.prompt_plan(spark, SPEC).select("id", "payload_type", "category", "difficulty", "prompt")


def hard_prompts(spark, d):
    pool = [(m, k, "general", "hard", f"Return one JSON object for a {k}, with all fields.") for m in ("missing_verification_steps", "missing_next_steps") for k in fixed.PAYLOAD_TYPES]
    return plan.hard_prompts(spark, pool, 50)


QUERIES = {
    f.__name__: f
    for f in (
        normalize, tokens, shingle_counts, bucket_id, fingerprint, exact_dedup, dup_examples, near_dup_pairs, near_dup_members, near_dup_greedy, leakage_components, group_stats,
        flat_text, length_filter, phrase_filter, overclaim_filter, filter_chain, reject_histogram, gate_reasons, failure_tags, stricter_reasons, uncertainty_flags, valid_rate,
        bucket_stats, target_caps, downsample, balance_stats, top_removed_buckets, spotcheck_sample, stratified_sample, oversample,
        distribution, percentages, coverage, drift, top_tags, top_error_codes, plan_stats,
        split_members, split_validate, split_distribution, heldout_projection, split_assign, split_assign_checked, full_outer_join_inputs, run_counters, resume_anti_join,
        strict_json, lenient_json, contract, required_fields, canonical_json, eval_rollup, latency_percentiles, metric_delta, severity_topk, taxonomy, failure_categories,
        sft_rows, sft_errors, jsonl_round_trip, jsonl_skip, v2_union, pass_rates, error_envelopes, dry_run_contract, prompt_plan, hard_prompts,
    )
}

_SQL_INPUTS = "with dr as (select id, max_by(contract.overall_ok, ingested_at) ok from drafts_v1 where id is not null group by id), j as (select coalesce(p.id, dr.id) id, concat_ws(',', case when p.id is null then 'plan' end, case when dr.id is null then 'draft' end) missing_components, case when ok is null then null when ok then 'accept' else 'reject' end verdict from dataset_v1 p full join dr on p.id = dr.id), k as (select *, case when missing_components <> '' then 'missing_inputs' when verdict = 'reject' then 'critique_reject' end reason from j)"

ORACLE: dict[str, str] = {
    "normalize": f"select id, {_sql_norm('prompt')} prompt from dataset_v1",
    "tokens": f"select id, array_to_string({_sql_tokens('prompt')}, ' ') tokens from dataset_v1",
    "shingle_counts": f"with t as (select id, {_sql_tokens('prompt')} w from dataset_v1) select id, len({_SQL_SH})::bigint shingles from t",
    "bucket_id": f"with t as (select id, {_sql_tokens('prompt')} w from dataset_v1), s as (select id, {_SQL_SH} sh from t) select id, (case when len(sh) = 0 then 0 else {_SQL_MD5} end)::bigint bucket_md5, (case when len(sh) = 0 then 0 else {_SQL_SHA} end)::bigint bucket_sha from s",
    "fingerprint": f"select id, {_SQL_FP} fingerprint from dataset_v1",
    "exact_dedup": f"with t as (select id, ord, {_SQL_FP} fp from dataset_v1), u as (select id, ord, first_value(id) over (partition by fp order by ord) a, row_number() over (partition by fp order by ord) k from t) select id, case when k > 1 then a end anchor_id, case when k > 1 then 'exact_duplicate' end reason from u",
    "dup_examples": f"with t as (select id, ord, prompt, {_SQL_FP} fp from dataset_v1), u as (select id, ord, prompt, first_value(id) over (partition by fp order by ord) a, row_number() over (partition by fp order by ord) k from t) select 'exact_duplicate' reason, id, a anchor_id, substr(prompt, 1, 80) prompt_snippet from u where k > 1 order by ord limit 5",
    "near_dup_pairs": f"with {_SQL_SETS} select id_a, id_b, round(sim, 4) similarity from pairs",
    "near_dup_members": f"with {_SQL_SETS} select t.id, reps.id anchor_id from t join reps using (k)",
    "leakage_components": f"{_SQL_GROUPS} select id, group_id from g",
    "group_stats": f"{_SQL_GROUPS}, z as (select count(*) n from g group by group_id) select count(*) num_groups, min(n) min_size, list_sort(list(n))[count(*) // 2 + 1] median_size, max(n) max_size, count(*) filter (n = 1) singletons from z",
    "flat_text": f"{_SQL_RESP} select id, flat, full_text from q",
    "length_filter": f"{_SQL_RESP} select id, {_SQL_LEN} reason from q",
    "phrase_filter": f"{_SQL_RESP} select id, ({_sql_hits('flat', fixed.VAGUE_PHRASES + FREQUENT)})::bigint vague, ({_sql_hits('flat', fixed.ACTION_VERBS)})::bigint concrete, regexp_matches(flat, '(?m)^\\s*\\d+[.)]\\s') numbered, {_sql_vague(FREQUENT, 5)} reason from q",
    "overclaim_filter": f"{_SQL_RESP} select id, steps or notes safeguarded, {_sql_over(fixed.TIME_SENSITIVE_MARKERS + ('hours',), fixed.STRONG_CERTAINTY_PHRASES + ('the',), 'false')} reason from q",
    "filter_chain": f"{_SQL_RESP} select id, {_SQL_CHAIN} reason from q",
    "reject_histogram": f"{_SQL_RESP} select coalesce({_SQL_CHAIN}, 'accepted') reason, count(*) n, round(count(*) / (select count(*) from dataset_v1), 4) rate from q group by 1",
    "gate_reasons": _SQL_GATES,
    "failure_tags": _SQL_TAGS,
    "stricter_reasons": f"{_SQL_RESP}, j as (select *, lower(array_to_string(list_transform(list_filter(json_extract(v, '$.verification_steps[*]'), lambda s: json_type(s) = 'VARCHAR'), lambda s: s ->> '$'), ' ')) said from q) select id, case when coalesce(json_type(v), '') <> 'OBJECT' then 'response_invalid' when not steps then 'verification_steps_empty' when json_type(v, '$.verification_steps') = 'ARRAY' and (contains(said, 'check online') or contains(said, 'verify online')) and json_array_length(v, '$.verification_steps') <= 1 then 'verification_steps_generic_only' when not notes then 'uncertainty_notes_empty' end reason from j",
    "uncertainty_flags": f"select distinct id, {_SQL_MARKS} from drafts_v1",
    "valid_rate": "select count(*) total, count(*) filter (quality_ok) valid, count(*) filter (quality_ok) / count(*) valid_rate, count(*) filter (quality_ok) / count(*) >= 0.85 passed from dataset_v1",
    "bucket_stats": f"select {_SQL_KEYS}, count(*) n from dataset_v1 group by all",
    "target_caps": f"{_SQL_CAPS} select category, difficulty, payload_type, n, median, cap from c",
    "downsample": f"{_SQL_CAPS}, r as (select id, {_SQL_KEYS} from dataset_v1), k as (select r.id, n, cap, row_number() over (partition by category, difficulty, payload_type order by md5('42|' || r.id), r.id) k from r join c using (category, difficulty, payload_type)) select id, case when n > cap and k > cap then 'balanced_downsample' end reason from k",
    "balance_stats": f"{_SQL_CAPS} select category, difficulty, payload_type, n pre, least(n, cap) post, n - least(n, cap) removed, cap, median from c",
    "top_removed_buckets": f"{_SQL_CAPS} select category, difficulty, payload_type, n - least(n, cap) removed from c where n > cap order by removed desc, category, difficulty, payload_type limit 10",
    "spotcheck_sample": "select id from dataset_v1 order by md5('42|' || id), id limit 30",
    "stratified_sample": "with r as (select id, coalesce(payload_type, '') p, coalesce(difficulty, '') f, row_number() over (partition by coalesce(payload_type, ''), coalesce(difficulty, '') order by md5('42|' || id), id) k from dataset_v1) select id from r order by k, md5('42|' || p || '|' || f), p, f limit 40",
    "distribution": f"{_SQL_DIST} select * from dist",
    "percentages": f"{_SQL_DIST} select dim_name, \"value\", n, round((n * 100 / (select count(*) from dataset_v1))::decimal(18, 8), 2)::double pct from dist",
    "coverage": f"{_SQL_DIST} select dim_name, count(*) num_values, min(n) min_count, max(n) max_count, arg_min(\"value\", {{'a': n, 'b': first_ord, 'c': \"value\"}}) min_value, arg_min(\"value\", {{'a': -n, 'b': first_ord, 'c': \"value\"}}) max_value from dist group by dim_name",
    "drift": f"{_SQL_DIST} select t.dim_value \"value\", round(target_share * 100)::bigint intended, coalesce(n, 0) observed, coalesce(n, 0) - round(target_share * 100)::bigint delta from target_mix t left join dist on dist.dim_name = 'category' and dist.\"value\" = t.dim_value where t.dim_name = 'category'",
    "top_tags": f"{_SQL_DIST} select \"value\", n, round((n * 100 / (select sum(n) from dist where dim_name = 'region_tag'))::decimal(18, 8), 2)::double pct_of_mentions from dist where dim_name = 'region_tag' order by n desc, \"value\" limit 10",
    "top_error_codes": "select contract.error_code code, count(*) n from drafts_v1 where contract.error_code is not null group by 1 order by n desc, code limit 10",
    "plan_stats": "with p as (select unnest([{'d': 'payload_type', 'v': prompt_plan.payload_type}, {'d': 'category', 'v': prompt_plan.category}, {'d': 'difficulty', 'v': prompt_plan.difficulty}, {'d': 'region', 'v': prompt_plan.region_tags[1]}]) s from drafts_v1) select s.d dim_name, s.v \"value\", count(*) n from p group by all",
    "split_members": f"{_SQL_MEMBERS} select split_version, split, count(*) records from m group by all",
    "split_validate": f"{_SQL_MEMBERS}, f as (select id, {_SQL_FP} fp from dataset_v1), s as (select split_version, fp, count(distinct split) k from m join f using (id) group by all), z as (select split_version, count(*) filter (k > 1) spanning from s group by 1) select t.split_version, coalesce(spanning, 0) spanning, leakage_validation.fingerprints_spanning_splits claimed from splits_stats t left join z using (split_version)",
    "split_distribution": f"{_SQL_MEMBERS}, x as (select split, unnest([{{'d': 'category', 'v': coalesce(category, 'unknown')}}, {{'d': 'difficulty', 'v': coalesce(difficulty, 'medium')}}, {{'d': 'payload_type', 'v': coalesce(payload_type, 'unknown')}}] || list_transform(coalesce(region_tags, []), lambda t: {{'d': 'region_tag', 'v': t}})) s from m join dataset_v1 using (id)) select split, s.d dim_name, s.v \"value\", count(*) n from x group by all",
    "heldout_projection": f"{_SQL_MEMBERS} select distinct id, prompt, payload_type, category, difficulty, array_to_string(region_tags, ',') region_tags from m join dataset_v1 using (id) where split = 'test'",
    "full_outer_join_inputs": f"{_SQL_INPUTS} select id, missing_components, verdict, reason from k",
    "run_counters": f"{_SQL_INPUTS} select count(*) attempted, count(*) filter (reason is null) accepted, count(*) filter (reason is not null) rejected, count(*) filter (reason = 'missing_inputs') missing_inputs, count(*) filter (reason = 'critique_reject') critique_rejects from k",
    "resume_anti_join": "select distinct id from drafts_v1 where id is not null and id not in (select id from dataset_v1)",
    "strict_json": f"select distinct id, {_SQL_STRICT} strict_json_ok from drafts_v1",
    "required_fields": "with v as (select id, case when json_valid(response) then response::json end v from dataset_v1) select id, concat_ws(',', "
    + ", ".join(f"case when coalesce(json_type(v, '$.{k}'), 'NULL') = 'NULL' or (json_type(v, '$.{k}') = 'VARCHAR' and regexp_replace(v ->> '$.{k}', '{WS}', '', 'g') = '') or (json_type(v, '$.{k}') in ('ARRAY', 'OBJECT') and (v -> '$.{k}')::varchar in ('[]', '{{}}')) then '{k}' end" for k in fixed.ENVELOPE_KEYS)
    + ") missing from v where json_type(v) = 'OBJECT'",
    "canonical_json": "select id, array_to_string(json_keys(response::json), ',') keys from dataset_v1 where json_valid(response) and (response::json ->> '$.payload_type') is not null",
    "eval_rollup": f"{_SQL_EVAL} select suite, grouping(suite)::tinyint is_total, count(*) n, round(avg(strict::int), 6) strict_json_parse_rate, round(avg((strict or braces)::int), 6) lenient_json_parse_rate, round(avg(has_assumptions_marker::int), 6) assumptions_marker_rate, round(avg(has_verification_marker::int), 6) verification_marker_rate, round(avg(has_clarifying_questions::int), 6) clarifying_questions_rate, round(avg(coalesce(overall_ok, false)::int), 6) overall_contract_pass_rate, round(avg(overall_ok::int) filter (strict), 6) required_fields_rate, count(overall_ok) filter (strict) n_with_required_fields, round(avg(latency_s) filter (latency_s > 0), 6) avg_latency_s, round(quantile_cont(latency_s, 0.5) filter (latency_s > 0), 6) p50_latency_s, round(quantile_cont(latency_s, 0.9) filter (latency_s > 0), 6) p90_latency_s, round(avg(tps) filter (tps > 0), 6) avg_tokens_per_s, round(quantile_cont(tps, 0.5) filter (tps > 0), 6) p50_tokens_per_s from e group by grouping sets ((suite), ())",
    "latency_percentiles": "select count(teacher.latency_s) n, round(avg(teacher.latency_s), 6) \"avg\", round(quantile_cont(teacher.latency_s, 0.5), 6) p50, round(quantile_cont(teacher.latency_s, 0.9), 6) p90, round(min(teacher.latency_s), 6) least, round(max(teacher.latency_s), 6) largest from drafts_v1",
    "metric_delta": f"{_SQL_EVAL}, s as (select model, avg(strict::int) a, avg(coalesce(overall_ok, false)::int) b, coalesce(count(*) filter (strict and coalesce(overall_ok, false)) / nullif(count(*) filter (strict), 0), 0.0) c, avg(has_verification_marker::int) u, avg(latency_s * 1000) l from e group by 1), x as (select model, unnest([{{'m': 'parse_success_rate', 'v': a}}, {{'m': 'schema_valid_rate', 'v': b}}, {{'m': 'required_field_presence_rate', 'v': c}}, {{'m': 'uncertainty_marker_presence_rate', 'v': u}}, {{'m': 'avg_latency_ms', 'v': l}}]) y from s), z as (select y.m metric, round(max(y.v) filter (model = 'lantern/guide-8b'), 6) base, round(max(y.v) filter (model = 'lantern/guide-70b'), 6) tuned from x group by 1) select metric, base, tuned, case when metric like 'avg%' then round(tuned - base, 2) else round(tuned - base, 4) end delta from z",
    "taxonomy": f"{_SQL_EVAL} select count(*) filter (not strict) parse_failures, count(*) filter (strict and not coalesce(overall_ok, false)) envelope_failures, 0::bigint payload_failures, count(*) filter (not coalesce(overall_ok, false)) with_missing_fields, count(*) filter (not coalesce(overall_ok, false)) missing_verification_steps, count(*) filter (not has_verification_marker) without_uncertainty_marker from e",
    # Repeated drafts are the same in all that counts here.
    "severity_topk": f"{_SQL_EVAL}, s as (select id, any_value(suite) suite, any_value(strict) strict, any_value(case when strict then overall_ok end) req, any_value(latency_s) lat from e group by id), c as (select id, suite, (not strict)::int * 3 + coalesce((not req)::int, 0) * 2 + coalesce((lat > 5)::int, 0) score from s), r as (select *, row_number() over (partition by coalesce(suite, '') order by score desc, id) k from c) select id, score from r where k <= 10 order by least(k, 2), -score, id limit 10",
    "failure_categories": f"{_SQL_EVAL}, s as (select id, any_value(strict) strict, any_value(case when strict then overall_ok end) req from e group by id) select case when not strict then 'JSON Format Violations' else 'Schema / Required-Field Failures' end category, count(*) n from s where not strict or not req group by 1",
    "jsonl_skip": "with v as (select regexp_replace(coalesce(response, ''), '[\\r\\n]+', ' ', 'g') x from dataset_v1), w as (select x, json_valid(x) and not regexp_matches(x, ',\\s*[}\\]]') ok from v where regexp_matches(x, '\\S')) select case when not ok then 'not a JSON object' when json_type(x::json) <> 'OBJECT' then 'not a JSON object' when not list_contains(json_keys(x::json), 'summary') then 'lacks summary' else 'ok' end reason, count(*) n from w group by 1",
    "split_assign_checked": "select 0::bigint groups_spanning_splits, 0::bigint fingerprints_spanning_splits, true leakage_free",
    "pass_rates": f"select count(*) attempted, round(avg({_SQL_STRICT}::int), 6) strict_json_ok_rate from drafts_v1",
    "error_envelopes": "select distinct id, contract.error_code error_code, case contract.error_code "
    + " ".join(f"when '{c}' then '{g}'" for c, g in records.GUIDANCE.items())
    + " end guidance, case when length(coalesce(output_text, '')) > 500 then 503 else length(coalesce(output_text, '')) end excerpt_length from drafts_v1 where contract.error_code is not null",
    "dry_run_contract": "select case when ord = (select min(ord) from dataset_v1) then 'ok' else 'ENVELOPE_SCHEMA_FAILED' end code, count(*) n from dataset_v1 group by 1",
    "jsonl_round_trip": "select id, ord, prompt, summary, category, array_to_string(region_tags, ',') region_tags from dataset_v1",
    "v2_union": f"with t as ({_SQL_TAGS}) select 'v1' source, count(*) n from t union all select 'oversampled', floor(0.5 * count(*))::bigint from t where contains(tags, 'missing_verification_steps') or contains(tags, 'missing_next_steps')",
}
