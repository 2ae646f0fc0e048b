"""Bounded reads and sinks of one file for each key."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspan.sources import files, readers


def test_heads_of_large_files(spark, tmp_path):
    """A sparse file of a gigabyte is read within the prefix, as its bytes tell: what lies beyond would not fit an array."""
    meta = {"meta": {"worldtrack": {"trackAlignment": {"type": "global_median_scale", "n": 3, "scale": 2.5}}}}
    for name, head in {"a": json.dumps(meta, indent=2)[:-2] + ',\n  "tracks": [1, {"trackAlignment": {"type": "global_median_scale", "scale": 9}}]', "b": "{}", "c": json.dumps(meta).replace("2.5", "-1")}.items():
        with open(tmp_path / f"{name}.json", "w") as f:
            f.write(head)
            if name == "a":
                f.truncate(1 << 30)
    (tmp_path / "other.txt").write_text("x" * 100)
    heads = files.file_heads(spark, f"{tmp_path}/*.json", 4096)
    assert heads.rdd.getNumPartitions() == 3
    assert {(r.path[-6:], r.length, r.n) for r in heads.select("path", "length", F.octet_length("head").alias("n")).collect()} == {("a.json", 1 << 30, 4096), ("b.json", 2, 2), ("c.json", os.path.getsize(tmp_path / "c.json"), os.path.getsize(tmp_path / "c.json"))}
    assert {(r.path[-6:], r.scale) for r in readers.alignment_scale(spark, f"{tmp_path}/*.json").collect()} == {("a.json", 2.5), ("b.json", None), ("c.json", None)}
    assert files.file_heads(spark, f"file://{tmp_path}/other.txt", 7).first()["head"] == b"x" * 7
    assert files.file_heads(spark, str(tmp_path)).count() == 4
    with pytest.raises(Exception, match="FileNotFoundError"):
        files.file_heads(spark, str(tmp_path / "absent.json")).count()


def test_an_archive_for_each_clip(spark, tmp_path):
    rng = np.random.default_rng(0)
    clips = {f"clip{k}": {"xyz": rng.normal(size=(5 + k, 3)), "mean": rng.normal(size=4)} for k in range(7)}
    clips["clip3"]["xyz"][1, 2] = np.nan
    rows = [(c, n, list(map(int, at)), None if np.isnan(v) else float(v)) for c, arrays in clips.items() for n, a in arrays.items() for at, v in np.ndenumerate(a)]
    df = spark.createDataFrame(rows, "clip string, name string, index array<long>, value double").repartition(5)
    out = str(tmp_path / "out")
    files.write_npz(df, out, "clip")
    assert sorted(os.listdir(out)) == [f"clip{k}.npz" for k in range(7)]
    for c, arrays in clips.items():
        with np.load(f"{out}/{c}.npz") as found:
            assert sorted(found) == ["mean", "xyz"] and all(np.array_equal(found[n], a, equal_nan=True) for n, a in arrays.items())
    again = readers.npz_values(spark, f"{out}/*.npz", ("xyz", "mean"))
    key = F.regexp_extract("path", r"(clip\d+)\.npz", 1)
    assert sorted(map(tuple, again.select(key, "name", "index", "value").collect()), key=str) == sorted(rows, key=str)
    # written again, a file is replaced whole, and the others stay
    files.write_npz(spark.createDataFrame([("clip0", "one", [0], 1.0)], "clip string, name string, index array<long>, value double"), out, "clip")
    with np.load(f"{out}/clip0.npz") as found:
        assert list(found) == ["one"]
    assert len(glob.glob(f"{out}/*")) == 7


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    good = spark.createDataFrame([(f"r{k}", json.dumps({"k": k})) for k in range(20)], "key string, value string")
    files.write_record_files(good, out, "key")
    assert {json.load(open(f))["k"] for f in glob.glob(f"{out}/*.json")} == set(range(20))
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/*")}
    for bad in ([("r1", "{}"), ("r1", "{}")], [("r2", "{}"), ("../r3", "{}")], [("r2", "{}"), ("", "{}")]):
        with pytest.raises(Exception, match="ValueError"):
            files.write_record_files(spark.createDataFrame(bad, "key string, value string"), out, "key")
        assert {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/*")} == before
    # a task that is killed between two files
    broken = good.select("key", F.when(F.col("key") == "r7", F.raise_error(F.lit("killed"))).otherwise(F.lit("[]")).alias("value"))
    with pytest.raises(Exception, match="killed"):
        files.write_record_files(broken, out, "key")
    assert {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/*")} == before
    files.write_record_files(good.limit(0), str(tmp_path / "none"), "key")
