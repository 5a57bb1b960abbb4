"""Queries of the training-data problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, components, defects, garbled, leaks, ledger, overlap, raking, truncation


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# Problem 1 -----------------------------------------------------------------------------------------------------------


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    groups = components.components(_read(spark, d, "dup_pairs").select("duplicate_id", "anchor_id"))
    return groups.where("record_id <> group_id").select("group_id", "record_id")


def p1_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    groups = components.components(_read(spark, d, "dup_pairs").select("duplicate_id", "anchor_id"))
    return groups.groupBy("group_id").agg(F.count("*").alias("members"))


# Problem 2 -----------------------------------------------------------------------------------------------------------


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return raking.sample_to_targets(_read(spark, d, "local_regression_v1"), _read(spark, d, "target_mix"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1].where("unmet").select("dim_name", "dim_value").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1]


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[0]


P2_FOUND_SQL = """
with pool as (select distinct id, coalesce(lower(trim(category, ' \t\n\r')), 'unknown') category, coalesce(lower(trim(payload_type, ' \t\n\r')), 'unknown') payload_type, coalesce(lower(trim(difficulty, ' \t\n\r')), 'medium') difficulty from local_regression_v1 where id is not null),
have as (select 'category' dim_name, category v, count(distinct id) n from pool group by all union all select 'payload_type', payload_type, count(distinct id) from pool group by all union all select 'difficulty', difficulty, count(distinct id) from pool group by all)
select distinct t.dim_name, t.dim_value from target_mix t left join have h on h.dim_name = t.dim_name and h.v = lower(trim(t.dim_value)) where greatest(t.min_rows, floor(t.sample_size * t.target_share + 0.5 + 1e-9)) > coalesce(h.n, 0)
"""


# Problem 4 -----------------------------------------------------------------------------------------------------------


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(ledger, keyed records) after the accepted base records, then the rest, went through the ledger as two batches."""
    from corpusmill.session import staged

    keyed = staged(ledger.keyed(_read(spark, d, "dataset_v1").select("id", "ord", "prompt", "summary", "payload_type")), "keyed")
    book = ledger.Ledger(spark)
    base = F.col("id").startswith("v1_")
    book.apply(keyed.where(base), "base")
    book.apply(keyed.where(~base), "later")
    return book.read(), keyed


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    book, keyed = _ledger(spark, d)
    twice = book.where("copies > 1").select("key", "keep_id")
    return keyed.join(twice, "key").where("id <> keep_id").select("keep_id", F.col("id").alias("dup_id")).distinct()


def p4_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d)[0].select("keep_id", "copies", "first_id")


# Problem 5 -----------------------------------------------------------------------------------------------------------


def _cut(spark: SparkSession, d: str) -> DataFrame:
    drafts = _read(spark, d, "drafts_v1").select("id", "output_text", F.col("teacher.selected_model").alias("source"))
    return truncation.truncated(drafts)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).where("cut").select("id").distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """source, drafts, cut, rate and the length most cut drafts of the source have; a draft delivered twice counts once."""
    once = _cut(spark, d).distinct()
    lengths = once.where("cut").groupBy("source", "chars").agg(F.count("*").alias("k")).groupBy("source").agg(F.max_by("chars", F.struct("k", "chars")).alias("usual_length"))
    rates = once.groupBy("source").agg(F.count("*").alias("drafts"), F.count_if("cut").alias("cut"), F.avg(F.col("cut").cast("int")).alias("rate"))
    return rates.join(lengths.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


# Problem 6 -----------------------------------------------------------------------------------------------------------


def _crossing(spark: SparkSession, d: str) -> DataFrame:
    return overlap.crossing(_read(spark, d, "dataset_v1"), _read(spark, d, "split_rows"), _read(spark, d, "splits_manifest"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _crossing(spark, d).select("id_a", "id_b").distinct()


def p6_by_split(spark: SparkSession, d: str) -> DataFrame:
    """split_version, split, source, records found in it that are in train too, and the zero that is claimed."""
    claim = _read(spark, d, "splits_stats").select("split_version", F.col("leakage_validation.fingerprints_spanning_splits").alias("claimed"))
    source = _read(spark, d, "dataset_v1").select(F.col("id").alias("held_id"), "source")
    found = _crossing(spark, d).groupBy("split_version", "split", "held_id").agg(F.max("overlap").alias("overlap")).join(source, "held_id")
    return found.groupBy("split_version", "split", "source").agg(F.count("*").alias("leaked"), F.avg("overlap").alias("mean_overlap")).join(claim, "split_version", "left")


# Problem 7 -----------------------------------------------------------------------------------------------------------


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    data, drafts = _read(spark, d, "dataset_v1"), _read(spark, d, "drafts_v1")
    pairs = defects.pairs_of(("dataset_v1", data, "prompt", F.col("response"), F.col("source")), ("drafts_v1", drafts, "prompt", F.col("output_text"), F.col("teacher.selected_model")))
    return defects.defects(pairs, _read(spark, d, "documents").select("text", "lang"))


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """table_name, defect, pairs: how many ids of each table have each defect."""
    return p7_found(spark, d).groupBy("table_name", "defect").agg(F.countDistinct("id").alias("pairs"))


# Problem 8 -----------------------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(_read(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return bpe.decoded(p8_ids(spark, d), "doc_id")


# Problem 9 -----------------------------------------------------------------------------------------------------------


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Windows that are the item's own words: an exact check after the similar ones were found."""
    return leaks.leaked(_read(spark, d, "documents"), _read(spark, d, "heldout_items")).where("similarity = 1").select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """item_id, documents with a passage of it, and documents with a similar passage only."""
    found = leaks.leaked(_read(spark, d, "documents"), _read(spark, d, "heldout_items"))
    return found.groupBy("item_id").agg(F.count_if(F.col("similarity") == 1).alias("leaked"), F.count_if(F.col("similarity") < 1).alias("similar"))


# Problem 10 ----------------------------------------------------------------------------------------------------------


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(_read(spark, d, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(_read(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_group_sizes": p1_group_sizes, "p2_found": p2_found, "p2_report": p2_report, "p2_sample": p2_sample,
    "p4_found": p4_found, "p4_ledger": p4_ledger, "p5_found": p5_found, "p5_rates": p5_rates, "p6_found": p6_found, "p6_by_split": p6_by_split, "p7_found": p7_found, "p7_rates": p7_rates, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_found": p9_found, "p9_items": p9_items,
    "p10_found": p10_found, "p10_restored": p10_restored,
}
P1_SQL = """
with recursive c as (select regexp_replace(duplicate_id, '^[\\t-\\r \\x{85}\\p{Z}]+|[\\t-\\r \\x{85}\\p{Z}]+$', '', 'g') l, regexp_replace(anchor_id, '^[\\t-\\r \\x{85}\\p{Z}]+|[\\t-\\r \\x{85}\\p{Z}]+$', '', 'g') r from dup_pairs),
d as (select case when l not in ('', 'unknown') then l end l, case when r not in ('', 'unknown') then r end r from c),
v as (select l id from d where l is not null union select r from d where r is not null),
e as (select l a, r b from d where l <> r union select r, l from d where l <> r),
reach(id, m) as (select id, id from v union select e.b, reach.m from reach join e on e.a = reach.id where reach.m < e.b),
g as (select id record_id, min(m) group_id from reach group by id)
"""
_BREAK, _LD = r"[\n\r|\x{2028}\x{85}]+", r"regexp_replace(replace(lower(upper(coalesce({0}, ''))), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g')"
P4_SQL = rf"""
with n as (select *, replace(lower(upper(coalesce(prompt, ''))), 'ß', 'ss') low from dataset_v1 where id is not null),
o as (select regexp_extract(p, '^[^\p{{L}}\p{{N}}]*(\p{{L}}+(?: \p{{L}}+){{0,2}})\s*:', 1) l from (select unnest(regexp_split_to_array(low, '{_BREAK}')) p from n where prompt is not null)),
k as (select string_agg(l, '|' order by length(l) desc, l) labels from (select l, count(*) c from o where l <> '' group by l) where c >= greatest(3, 0.02 * (select count(*) from dataset_v1))),
q as (select id, ord, summary, payload_type, list_filter(regexp_split_to_array(low, '{_BREAK}'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) parts, labels from n, k),
r as (select *, case when len(parts) < 2 then 0 else coalesce(nullif(list_position(list_transform(parts[1:len(parts) - 1], lambda x: regexp_matches(x, '^[^\p{{L}}\p{{N}}]*(?:' || labels || ')(?:[^\p{{L}}\p{{N}}]|$)|^[^:.!?]+:')), false), 0) - 1, case when regexp_matches(parts[-1], '^[^\p{{L}}\p{{N}}]*(?:' || labels || ')\s*:') then len(parts) else len(parts) - 1 end) end h from q),
t as (select id, ord, array_to_string(list_sort(list_transform(parts[1:h], lambda x: {_LD.format('x')})), '|') || '||' || array_to_string(list_transform(parts[h + 1:len(parts)], lambda x: {_LD.format('x')}), '') || chr(10) || {_LD.format('summary')} || chr(10) || {_LD.format('payload_type')} key from r),
g as (select key, min(id) keep_id, count(*) copies, arg_min(id, {{'o': ord, 'i': id}}) first_id from t group by key)
"""
# The words as they stand and without tags and JSON escapes; windows of 12 joined as text.
_P9_WORDS = lambda x: f"regexp_extract_all(lower(regexp_replace({x}, '[\\p{{Cf}}\\p{{Mn}}]', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"
_P9_BARE = r"""regexp_replace(regexp_replace(text, '\\(?:u[0-9a-fA-F]{4}|[nrtbf"/\\])', ' ', 'g'), '</?[A-Za-z|!][^<>]{0,200}>', ' ', 'g')"""
_P9_WINDOWS = lambda k, t: f"(select distinct {k}, array_to_string(w[i:i + 11], ' ') t from (select {k}, w, unnest(range(1, len(w) - 10)) i from (select {k}, {_P9_WORDS('text')} w from {t} union all select {k}, {_P9_WORDS(_P9_BARE)} from {t})))"
P9_SQL = f"select distinct doc_id, item_id from {_P9_WINDOWS('doc_id', 'documents')} join {_P9_WINDOWS('item_id', 'heldout_items')} using (t)"

ORACLE = {
    "p1_found": P1_SQL + "select group_id, record_id from g where group_id <> record_id", "p1_group_sizes": P1_SQL + "select group_id, count(*) members from g group by 1",
    "p2_found": P2_FOUND_SQL, "p4_found": P4_SQL + "select distinct keep_id, id dup_id from t join g using (key) where id <> keep_id", "p4_ledger": P4_SQL + "select keep_id, copies, first_id from g",
    "p9_found": P9_SQL, "p8_round_trip": "select doc_id, coalesce(text, '') as text from documents",
}
