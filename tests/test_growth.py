"""Faults that show only on larger tables or on rows that the smallest ones lack."""

import datetime
import io

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlspan.operators import audit, programs, windows
from marlspan.plans.catalog import QUERIES, SQL
from marlspan.sources import files, writers
from test_plans import rows


def test_a_cited_grounding_without_a_clip_of_its_own(spark, tmp_path):
    """The registry knows the clip of a grounding whose provenance in the trace does not say it."""
    at = datetime.datetime(2024, 1, 1)
    events = [(59, at, 1, "click"), (401, at, 1, "view"), (402, at, 1, "view"), (118, at, 2, "click"), (403, at, 2, "view")]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    found = QUERIES["tool_trace_audit"](spark, str(tmp_path))
    want = con.sql(SQL["tool_trace_audit"])
    got = rows(found.columns, found.collect())
    assert got == rows(want.columns, want.fetchall())
    assert ("invalid_query_provenance", 1, 1) in {(r.code, r.n, r.questions) for r in found.collect()}


def test_gaps_are_filled_in_one_pass(spark):
    """As numpy fills them, and without a frame that is read anew for every row up to the end of its key."""
    n, rng = 5000, np.random.default_rng(3)
    values = [None if hole else float(v) for v, hole in zip(rng.normal(size=n), rng.random(n) < 0.4)]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)] + [(2, 0, None), (2, 1, None)], "k int, frame long, v double")
    out = df.withColumn("f", windows.filled("v", "k"))
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {(r.k, r.frame): r.f for r in out.collect()}
    there = [k for k, v in enumerate(values) if v is not None]
    want = np.interp(range(n), there, [values[k] for k in there])
    assert np.allclose([got[1, k] for k in range(n)], want) and got[2, 0] is None and got[2, 1] is None
    plan = windows.running_mean(df, "v", "k", "m")._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan


def test_many_files_share_partitions(spark, tmp_path):
    """A task for each of many small files takes as long as there are files; each is still read within its bound."""
    for k in range(1000):
        (tmp_path / f"f{k}.json").write_text("x" * (k + 1))
    heads = files.file_heads(spark, f"{tmp_path}/*.json", 700)
    assert heads.rdd.getNumPartitions() <= files.MOST_PARTS
    got = sorted((r.length, len(r.head)) for r in heads.collect())
    assert got == [(k + 1, min(k + 1, 700)) for k in range(1000)]


def test_texts_of_record_files_are_not_shuffled(spark, tmp_path):
    """A value that is made of a row's columns is made where its file is written, and a key that comes twice is an error still."""
    df = spark.createDataFrame([(k, k % 7) for k in range(50)], "k long, n int")
    made = F.concat(F.lit("v"), F.repeat(F.lit("x"), F.col("n")))
    files.write_record_files(df, str(tmp_path / "a"), "k", made)
    assert {f.stem: f.read_text() for f in (tmp_path / "a").glob("*.json")} == {str(k): "v" + "x" * (k % 7) for k in range(50)}
    with pytest.raises(Exception, match="ValueError"):
        files.write_record_files(df.unionAll(df), str(tmp_path / "b"), "k", made)


def test_archives_keep_numbers_only(spark, tmp_path):
    """What a writer holds of a batch is flat arrays, a few bytes for each value, and the archive is as before."""
    n = 20_000
    batch = pa.RecordBatch.from_pydict({"key": ["a"] * n, "name": ["xyz"] * n, "index": [[k // 3, k % 3] for k in range(n)], "value": [None if k % 5 == 0 else float(k) for k in range(n)]})
    writer = files.NpzWriter(str(tmp_path), ".npz")
    parts = [writer.gathered(batch.slice(a, 7000)) for a in (0, 7000, 14000)]
    held = sum(x.nbytes for p in parts for pair in p.values() for x in pair)
    assert held <= 16 * n and all(x.base is None or x.base.nbytes <= 2 * x.nbytes for p in parts for pair in p.values() for x in pair)
    with np.load(io.BytesIO(writer.content(parts))) as found:
        flat = found["xyz"].ravel()[:n]
    assert np.array_equal(flat, [np.nan if k % 5 == 0 else k for k in range(n)], equal_nan=True)


def test_files_that_a_run_does_not_keep_are_deleted_by_tasks(spark, tmp_path):
    for k in range(600):
        (tmp_path / f"f{k}.json").write_text("{}")
    (tmp_path / "masks").mkdir()
    (tmp_path / "masks" / "m.txt").write_text("m")
    keep = spark.range(0, 600, 3).select(F.concat(F.lit("f"), "id", F.lit(".json")).alias("name"))
    assert writers.discard_others(str(tmp_path), keep) == 401
    assert {f.name for f in tmp_path.iterdir()} == {f"f{k}.json" for k in range(0, 600, 3)}
    assert {r.name for r in files.entries(spark, str(tmp_path)).collect()} == {f"f{k}.json" for k in range(0, 600, 3)}


def test_trace_rules_sort_no_wide_rows(spark):
    """A repeated id is found by what its trace made before: no window by id, for which texts and lists would be sorted; and keys are spread by rows."""
    ids = ["query_1", None, "query_2", "query_1", None, "query_1"]
    df = spark.createDataFrame([(q, k, "x", "x", "", "ok", i) for q, n in ((1, 6), (2, 3)) for k, i in enumerate(ids[:n])], "question_id long, step long, raw string, effective string, suffix string, status string, evidence_id string")
    none = F.lit(None).cast("int")
    df = df.withColumns({"span_start": none, "span_end": none, "action": F.lit(None).cast("string"), "refs": F.array().cast("array<string>"), "available": F.array().cast("array<string>")})
    found = audit.violations(df, audit.trace_rules(), "question_id", "step")
    assert sorted((r.key, r.step) for r in found.where("code = 'duplicate_evidence_id'").collect()) == [(1, 3), (1, 5)]
    assert "row_number" not in found._jdf.queryExecution().executedPlan().toString()
    assert windows.spread(spark.range(1000), "id", 50).rdd.getNumPartitions() == 20


def test_plain_numbers_are_bound_without_an_array_each():
    """An array for each number took more than half of a short program's time; the codes of bad bindings are as before."""
    assert type(programs.bound('{"a": 1.5}')["a"]) is float
    assert [programs.bound(t) for t in ('{"a": NaN}', '{"a": -Infinity}', '{"_a": 1.5}', '{"a": "x"}')] == ["binding_value", "binding_value", "binding_name", "binding_value"]
    given = ['{"a": 1.5, "b": 2}', '{"a": 3, "b": 0.5}', '{"a": [1.5, 2], "b": 1.0}', '{"a": true, "b": 1e308}']
    found = programs.run_rows(["m = a * 2 + b"] * 4, given)
    assert [x and x["m"] for x, _ in found] == [5.0, 6.5, [4.0, 5.0], 1e308] and not any(e for _, e in found)
