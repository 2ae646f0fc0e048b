"""Audits of whole attempts, exemptions, wrapped lines."""

import json
import textwrap

from pyspark.sql import functions as F

from marlspan.functions import text as tx
from marlspan.operators import audit


def test_attempts(spark):
    new, old = {"status": "ok", "call_id": "qg_1", "effective_response": ""}, {"status": "ok", "call_id": "qg_1"}
    payloads = {
        "good": {"trace": [new, {"status": "rejected", "call_id": "qg_2"}, {"status": "ok", "call_id": "math_1"}], "evidence": {"qg_1": {"deep": {"x": 1}}, "math_1": 2}},
        "order": {"trace": [new, {"status": "ok", "call_id": "math_1"}], "evidence": {"math_1": 2, "qg_1": 1}},
        "cached": {"trace": [new, {"status": "ok", "call_id": "qg_1", "cache_hit": True}], "evidence": {"qg_1": 1}},
        "final": {"trace": [{"status": "ok", "call_id": "final_1", "evidence_state": {}}], "evidence": {}},
        "old": {"trace": [old, old], "evidence": {"other": 1}}, "rows": {"trace": [new, 7, "x", None, []], "evidence": {"qg_1": 1}}, "none": {}, "kinds": {"trace": {"a": 1}, "evidence": [1]}, "empty": {"trace": [], "evidence": {"qg_1": 1}},
    }
    records = spark.createDataFrame([(k, json.dumps(v)) for k, v in payloads.items()] + [("broken", "{")], "id string, payload string")
    found = {tuple(r) for r in audit.attempt_violations(records, "id", "payload").collect()}
    assert found == {
        ("order", None, "final_registry_mismatch"), ("rows", 2, "invalid_trace_row"), ("rows", 3, "invalid_trace_row"), ("rows", 4, "invalid_trace_row"), ("rows", 5, "invalid_trace_row"),
        ("none", None, "invalid_trace"), ("none", None, "invalid_registry"), ("kinds", None, "invalid_trace"), ("kinds", None, "invalid_registry"), ("broken", None, "invalid_trace"), ("broken", None, "invalid_registry"),
    }
    assert {r.key for r in audit.attempts(records, "id", "payload").where("legacy").collect()} == {"old"}
    assert [tuple(r) for r in audit.attempt_violations(records.limit(0), "id", "payload").collect()] == [("<directory>", None, "no_answer_records")]


def test_older_traces_are_exempt(spark):
    df = spark.createDataFrame([("a", 0, True), ("a", 1, True), ("b", 0, False), ("b", 1, None)], "k string, step int, old boolean")
    rules = [audit.Rule("any", F.lit(True)), audit.Rule("all", F.count("*") > 0, whole=True)]
    assert {(r.key, r.code) for r in audit.violations(df, rules, "k", "step", "old").collect()} == {("b", "any"), ("b", "all")}
    assert audit.violations(df, rules, "k", "step").count() == 6


def test_wrapped_lines(spark):
    texts = ["", "one", "two words  and\n more of them", "x" * 25, "a " * 40, "word " + "y" * 23 + " end", "  lead", "exactly ten exactly ten", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.wrapped("t", 10).alias("w")).collect()
    for t, r in zip(texts, rows):
        if t is None:
            assert r.w is None
        else:
            lines = r.w.split("\n")
            assert all(len(x) <= 10 for x in lines) and "".join(lines).replace(" ", "") == "".join(t.split())
            if max(map(len, t.split()), default=0) <= 10:
                assert lines == (textwrap.wrap(" ".join(t.split()), 10) or [""])


def test_work_that_fails_in_columns(spark):
    from marlspan.operators import stages

    df = spark.createDataFrame([("8", 2), ("x", 2), ("8", 0), (None, 1), ("x", 0)], "t string, k int")
    out = stages.tried(df, "v", F.try_divide(F.expr("try_cast(t as double)"), "k"), ("ValueError", F.col("t").isNotNull() & F.expr("try_cast(t as double)").isNull()), ("ZeroDivisionError", F.col("k") == 0))
    assert [(r.v, r.error) for r in out.collect()] == [(4.0, None), (None, "ValueError"), (None, "ZeroDivisionError"), (None, None), (None, "ValueError")]


def test_places_of_equal_values(spark):
    """One value in all rows: the ranges are cut by the ties, none has all rows."""
    from marlspan.operators import sampling

    df = spark.range(5000).select("id", F.lit(7).alias("v")).repartition(7)
    out = sampling.ordered_index(df, "v", "id", buckets=16)
    assert [(r.id, r["index"]) for r in out.orderBy("id").collect()] == [(k, k) for k in range(5000)]
