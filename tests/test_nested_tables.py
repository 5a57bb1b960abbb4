"""Problem 3: every repeated ancestor has its table, and every child row its parent, on the smallest data."""

import json

SMALL = "/root/testdata/sf0.001"


def _rows(spark, name, *columns):
    import __spark_entry__

    return [tuple(r) for r in __spark_entry__.queries()[name](spark, SMALL).select(*columns).collect()]


def test_days_of_both_sources(spark):
    days = _rows(spark, "p3_days", "record_id", "trip_days_no", "day", "summary")
    table = spark.read.parquet(f"{SMALL}/itinerary_valid.parquet").collect()
    want = {(r.record_id, k, d and d.day_no is not None and str(d.day_no) or None, d and d.summary) for r in table for k, d in enumerate(r.trip_days or ())}
    valid = {r.record_id for r in table}
    assert want and {x for x in days if x[0] in valid} == want
    assert {x for x in days if x[0] not in valid}


def test_groups_of_both_sources(spark):
    groups = _rows(spark, "p3_groups", "record_id", "outer_no", "name")
    table = spark.read.parquet(f"{SMALL}/checklist_valid.parquet").collect()
    want = {(r.record_id, k, g and g.group_name) for r in table for k, g in enumerate(r.check_groups or ())}
    valid = {r.record_id for r in table}
    assert want and {x for x in groups if x[0] in valid} == want
    assert {x for x in groups if x[0] not in valid}


def test_items_have_parents(spark):
    assert set(_rows(spark, "p3_checklist_items", "record_id", "outer_no")) <= set(_rows(spark, "p3_groups", "record_id", "outer_no"))
    assert set(_rows(spark, "p3_itinerary_items", "record_id", "trip_days_no")) <= set(_rows(spark, "p3_days", "record_id", "trip_days_no"))


def test_item_fields_and_warnings_of_both_sources(spark):
    item, warning = ("record_id", "trip_days_no", "items_no", "booking_needed"), ("record_id", "trip_days_no", "items_no", "warnings_no", "warning")
    items, warnings = set(_rows(spark, "p3_itinerary_items", *item)), _rows(spark, "p3_warnings", *warning)
    table = spark.read.parquet(f"{SMALL}/itinerary_valid.parquet").collect()
    at = [(r.record_id, k, m, x) for r in table for k, d in enumerate(r.trip_days or ()) for m, x in enumerate(d and d["items"] or ())]
    valid = {r.record_id for r in table}
    flag = {True: "true", False: "false", None: None}
    assert {x for x in items if x[0] in valid} == {(r, k, m, flag[x and x.booking_needed]) for r, k, m, x in at}
    want = sorted((r, k, m, n, w) for r, k, m, x in at if x for n, w in enumerate(x.warnings or ()))
    assert want and sorted(x for x in warnings if x[0] in valid) == want
    assert {x for x in warnings if x[0] not in valid}
    assert {x[:3] for x in warnings} <= {x[:3] for x in items}


def test_warnings_of_any_shape():
    from corpusmill import nested

    text = '{"payload": {"trip_days": {"items": [{"warnings": ["a", null, "b"]}, {"warnings": "c"}, {"warnings": []}, {"warnings": null}]}}}'
    rows = [(at, row.get("warning")) for _, at, row in nested.rows_of(text, (nested.RESPONSE_WARNINGS,))]
    assert rows == [((0, 0, 0), "a"), ((0, 0, 1), None), ((0, 0, 2), "b"), ((0, 1, 0), "c")]


def test_json_text_after_much_white_space():
    import json

    from corpusmill import nested

    for blanks in (0, 63, 64, 500):
        text = json.dumps({"payload": " \n" * blanks + '{"groups": [{"items": [{"text": "pack"}]}]}'})
        assert [row for *_, row in nested.rows_of(text, (nested.RESPONSE_CHECKS,))] == [{"text": "pack"}]


def test_p3_items_of_typed_tables(spark):
    import __spark_entry__

    want = set()
    for table, outer, leaf in (("itinerary_valid", "trip_days", lambda x: x.transport and x.transport.mode), ("checklist_valid", "check_groups", lambda x: x.text)):
        for r in spark.read.parquet(f"{SMALL}/{table}.parquet").collect():
            for k, d in enumerate(r[outer] or ()):
                for m, x in enumerate(d and d["items"] or ()):
                    if x and (leaf(x) or "").strip():
                        want.add((r.record_id, k, m, leaf(x)))
    ids = {w[0] for w in want}
    got = {tuple(r) for r in __spark_entry__.queries()["p3_found"](spark, SMALL).collect()}
    assert want and {g for g in got if g[0] in ids} == want


def test_p3_broken_text_gives_nothing():
    from corpusmill import nested

    whole = json.dumps({"payload": {"groups": [{"items": ["a", None, {"text": "b"}]}]}})
    assert len(list(nested.rows_of(whole, (nested.RESPONSE_CHECKS,)))) == 3
    for text in ("", " ", "null", "7", whole[:-1], whole + "x", f"[{whole},{whole}]"):
        assert not [r for r in nested.rows_of(text, (nested.RESPONSE_CHECKS,)) if r[2]]
