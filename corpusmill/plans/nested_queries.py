"""Queries of the nested-record operator (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import nested


_ITEMS = ((nested.RESPONSE_ITEMS, nested.RESPONSE_CHECKS), (nested.VALID_ITEMS,), (nested.VALID_CHECKS,))


def _sources(spark: SparkSession, d: str, tables: tuple[tuple[nested.Table, ...], ...] = _ITEMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of the given tables of dataset_v1.response, itinerary_valid and checklist_valid."""
    read = lambda t, *c: spark.read.parquet(f"{d}/{t}.parquet").select(*c)
    data = read("dataset_v1", "id", "response")
    trips = read("itinerary_valid", "record_id", F.to_json(F.struct("trip_days"), {"ignoreNullFields": "false"}).alias("j"))
    checks = read("checklist_valid", "record_id", F.to_json(F.struct("check_groups"), {"ignoreNullFields": "false"}).alias("j"))
    return (
        nested.grouped(data, "id", F.col("response"), tables[0]),
        nested.grouped(trips, "record_id", F.col("j"), tables[1]),
        nested.grouped(checks, "record_id", F.col("j"), tables[2]),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """record_id, outer_no, item_no, leaf: every itinerary item with a mode, every checklist item with a text."""
    a, b, c = _sources(spark, d)
    rows = a.unionByName(b).unionByName(c)
    leaf = F.when(F.col("table_name") == "itinerary_items", F.col("fields")["mode"]).otherwise(F.col("fields")["text"])
    return rows.select("record_id", F.col("ordinals")[0].alias("outer_no"), F.col("ordinals")[1].alias("item_no"), leaf.alias("leaf")).where(F.col("leaf").rlike(r"(?U)[^\s​﻿]")).distinct()


def p3_itinerary_items(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _sources(spark, d)
    return nested.pivoted(a, nested.RESPONSE_ITEMS).unionByName(nested.pivoted(b, nested.VALID_ITEMS))


def p3_checklist_items(spark: SparkSession, d: str) -> DataFrame:
    a, _, c = _sources(spark, d)
    return nested.pivoted(a, nested.RESPONSE_CHECKS).withColumnRenamed("groups_no", "outer_no").unionByName(nested.pivoted(c, nested.VALID_CHECKS).withColumnRenamed("check_groups_no", "outer_no"))


def p3_days(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _sources(spark, d, ((nested.RESPONSE_DAYS,), (nested.VALID_DAYS,), ()))
    return nested.pivoted(a, nested.RESPONSE_DAYS).unionByName(nested.pivoted(b, nested.VALID_DAYS))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    a, _, c = _sources(spark, d, ((nested.RESPONSE_GROUPS,), (), (nested.VALID_GROUPS,)))
    return nested.pivoted(a, nested.RESPONSE_GROUPS).withColumnRenamed("groups_no", "outer_no").unionByName(nested.pivoted(c, nested.VALID_GROUPS).withColumnRenamed("check_groups_no", "outer_no"))


def p3_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Each warning of an itinerary item, by the record and the places of day, item and warning."""
    a, b, _ = _sources(spark, d, ((nested.RESPONSE_WARNINGS,), (nested.VALID_WARNINGS,), ()))
    return nested.pivoted(a, nested.RESPONSE_WARNINGS).unionByName(nested.pivoted(b, nested.VALID_WARNINGS))


QUERIES = {"p3_found": p3_found, "p3_itinerary_items": p3_itinerary_items, "p3_checklist_items": p3_checklist_items, "p3_days": p3_days, "p3_groups": p3_groups, "p3_warnings": p3_warnings}
# SQL: the same shapes with json functions. DuckDB takes JSON with a comma before a closing bracket for valid.


def _sql_object(x: str) -> str:
    """JSON text in place of an object."""
    return f"(case when json_type({x}) = 'VARCHAR' and regexp_matches({x} ->> '$', '^[ \\t\\n\\r]*\\{{') and json_valid({x} ->> '$') then ({x} ->> '$')::json else {x} end)"


def _sql_list(x: str) -> str:
    """A list, or what stands in place of one as its only entry."""
    return f"(case when json_type({x}) = 'ARRAY' then json_extract({x}, '$[*]') when coalesce(json_type({x}), 'NULL') = 'NULL' then []::json[] else [{x}] end)"


_ENTRY = "with v as (select id, response::json j from dataset_v1 where json_valid(response) and not regexp_matches(response, ',\\s*[}\\]]')), w as (select id, case when json_type(j) = 'ARRAY' then case when json_array_length(j) = 1 then j -> '$[0]' end else j end j from v), p as (select id, " + _sql_object("(j -> '$.payload')") + " p from w)"
_LEVEL = lambda name, of, path, keep: f"{name}0 as (select {keep}, {_sql_list(_sql_object(f"({of[1]} -> '$.{path}')"))} l from {of[0]}), {name} as (select {keep}, generate_subscripts(l, 1) - 1 k{name}, unnest(l) x{name}_ from {name}0), {name}_o as (select {keep}, k{name}, {_sql_object(f'x{name}_')} x{name} from {name})"
_DAYS = _LEVEL("d", ("p", "p"), "trip_days", "id") + ", " + _LEVEL("i", ("d_o", "xd"), "items", "id, kd")
_GROUPS = _LEVEL("g", ("p", "p"), "groups", "id") + ", " + _LEVEL("c", ("g_o", "xg"), "items", "id, kg")
_TYPED = lambda table, outer: f"{outer}_t as (select record_id, generate_subscripts({outer}, 1) - 1 o, unnest({outer}) x from {table})"
_TYPED_ITEMS = lambda outer: f"{outer}_i as (select record_id, o, generate_subscripts(x.items, 1) - 1 n, unnest(x.items) y from {outer}_t)"
_SHOWN = r"regexp_matches({0}, '[^\t-\r \x{{85}}\p{{Z}}\x{{200b}}\x{{feff}}]')"
_STRING = lambda x: f"case when json_type({x}) = 'VARCHAR' then {x} ->> '$' end"
_MODE = "case when json_type(t) = 'OBJECT' then " + _STRING("(t -> '$.mode')") + " else " + _STRING("t") + " end"
_TEXT = "case when json_type(xc) = 'OBJECT' then " + _STRING("(xc -> '$.text')") + " else " + _STRING("xc") + " end"

_FIELD = lambda x, k: f"case when json_type({x}, '$.{k}') not in ('OBJECT', 'ARRAY', 'NULL') then {x} ->> '$.{k}' end"
_WARNINGS = _LEVEL("u", ("i_o", "xi"), "warnings", "id, kd, ki")
_WARNING = "case when json_type(xu) = 'OBJECT' then " + _FIELD("xu", "warning") + " else " + _STRING("xu") + " end"

ORACLE: dict[str, str] = {
    "p3_itinerary_items": f"{_ENTRY}, {_DAYS}, {_TYPED('itinerary_valid', 'trip_days')}, {_TYPED_ITEMS('trip_days')}, t as (select id, kd, ki, xi, {_sql_object("(xi -> '$.transport')")} t, {_sql_object("(xi -> '$.cost_estimate')")} c from i_o) select id record_id, kd trip_days_no, ki items_no, {_FIELD('xi', 'time_block')} time_block, {_FIELD('xi', 'activity')} activity, case when json_type(t) = 'OBJECT' then {_FIELD('t', 'mode')} else {_STRING('t')} end \"mode\", {_FIELD('t', 'details')} details, {_FIELD('c', 'currency')} cost_currency, {_FIELD('c', 'amount')} cost_amount, {_FIELD('xi', 'booking_needed')} booking_needed, {_FIELD('xi', 'location')} place from t union all select record_id, o, n, y.time_block, y.activity, y.transport.mode, y.transport.details, y.cost_estimate.currency, y.cost_estimate.amount::varchar, y.booking_needed::varchar, y.place from trip_days_i",
    "p3_checklist_items": f"{_ENTRY}, {_GROUPS}, {_TYPED('checklist_valid', 'check_groups')}, {_TYPED_ITEMS('check_groups')} select id record_id, kg outer_no, kc items_no, {_TEXT} \"text\", {_FIELD('xc', 'priority')} priority, {_FIELD('xc', 'when')} when_due, {_FIELD('xc', 'done')} done, {_FIELD('xc', 'notes')} notes from c_o union all select record_id, o, n, y.\"text\", y.priority, y.when_due, y.done::varchar, y.notes from check_groups_i",
    "p3_warnings": f"{_ENTRY}, {_DAYS}, {_WARNINGS}, {_TYPED('itinerary_valid', 'trip_days')}, {_TYPED_ITEMS('trip_days')} select id record_id, kd trip_days_no, ki items_no, ku warnings_no, {_WARNING} \"warning\" from u_o union all select record_id, o, n, generate_subscripts(y.warnings, 1) - 1, unnest(y.warnings) from trip_days_i",
    "p3_found": f"{_ENTRY}, {_DAYS}, {_GROUPS}, {_TYPED('itinerary_valid', 'trip_days')}, {_TYPED_ITEMS('trip_days')}, {_TYPED('checklist_valid', 'check_groups')}, {_TYPED_ITEMS('check_groups')}, t as (select id, kd, ki, {_sql_object("(xi -> '$.transport')")} t from i_o), "
    f"a as (select id record_id, kd outer_no, ki item_no, {_MODE} leaf from t union all select id, kg, kc, {_TEXT} from c_o union all select record_id, o, n, y.transport.mode from trip_days_i union all select record_id, o, n, y.\"text\" from check_groups_i) select distinct record_id, outer_no, item_no, leaf from a where {_SHOWN.format('leaf')}",
    "p3_days": f"{_ENTRY}, {_DAYS}, {_TYPED('itinerary_valid', 'trip_days')} select id record_id, kd trip_days_no, case when json_type(xd, '$.day') not in ('OBJECT', 'ARRAY', 'NULL') then xd ->> '$.day' end \"day\", case when json_type(xd, '$.summary') not in ('OBJECT', 'ARRAY', 'NULL') then xd ->> '$.summary' end summary from d_o union all select record_id, o, x.day_no::varchar, x.summary from trip_days_t",
    "p3_groups": f"{_ENTRY}, {_GROUPS}, {_TYPED('checklist_valid', 'check_groups')} select id record_id, kg outer_no, case when json_type(xg, '$.name') not in ('OBJECT', 'ARRAY', 'NULL') then xg ->> '$.name' end name from g_o union all select record_id, o, x.group_name from check_groups_t",
}
