"""Operators on small cases with known answers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspan.functions import numeric as num
from marlspan.functions import text as tx
from marlspan.operators import actions, audit, robust, sampling, scoring, windows
from marlspan.sources import readers, writers
from marlspan.streaming import incremental


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("<answer> b </answer>", "B"), ("<C>", "C"), ("A. because", "A"), ("**D**", "D"), ("the answer is: c", "C"), ("<answer>Z</answer>", None), ("", None), ("nothing", None)])
def test_choice_letter(spark, text, want):
    assert one(spark, tx.choice_letter("t"), t=text) == want


@pytest.mark.parametrize("text, want", [("A: x; B: y;", {"A": "x", "B": "y"}), ("A. x; B. y", {"A": "x", "B": "y"}), ("A: x; A: y", None), ("A: x", None), ("A: x; B:", None), ("x; y", None)])
def test_option_map(spark, text, want):
    assert one(spark, tx.option_map("t"), t=text) == want


def test_option_list_falls_back_to_place(spark):
    assert one(spark, tx.option_list_map("t"), t=["A. x", "A) y", "z"]) == {"A": "x", "B": "A) y", "C": "z"}


def test_families_take_the_first_rule(spark):
    assert one(spark, tx.family("q", "o"), q="How many dogs appear larger?", o="two") == "instance_count"
    assert one(spark, tx.family("q", "o"), q="?", o="3 m/s") == "metric_speed"
    assert one(spark, tx.all_families("q", "o"), q="How many dogs appear larger?", o="") == ["instance_count", "apparent_size"]


@pytest.mark.parametrize("a, b, want", [(170, -170, -20), (-170, 170, 20), (0, 180, -180), (90, 0, 90)])
def test_wrapped_difference(spark, a, b, want):
    assert one(spark, num.wrapped_difference("a", "b"), a=float(a), b=float(b)) == want


@pytest.mark.parametrize("angle, want", [(0, "front"), (44.9, "front"), (45, "right"), (180, "back"), (-180, "back"), (-90, "left")])
def test_quadrants(spark, angle, want):
    assert one(spark, num.quadrant("a")[0], a=float(angle)) == want


def test_direction_words(spark):
    at = lambda x, y, z: one(spark, num.direction(tuple(map(F.col, "xyz"))), x=float(x), y=float(y), z=float(z))
    assert [at(1, 0, 0), at(0, -1, 0), at(-1, 1, 1), at(0, 0, 0)] == ["right", "up", "down-left-forward", "stationary"]


def test_rotation_turns_about_an_axis(spark):
    m = num.rotation((F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(90.0))
    v = num.matrix_vector(m, (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    got = [one(spark, c) for c in v]
    assert np.allclose(got, [0, 1, 0], atol=1e-12)


def frames(spark, values, key="a"):
    return spark.createDataFrame([(key, k, v) for k, v in enumerate(values)], "k string, frame long, v double")


def test_running_mean_keeps_gaps(spark):
    got = [r.s for r in windows.running_mean(frames(spark, [0.0, None, 2.0, 3.0]), "v", "k", "s").orderBy("frame").collect()]
    assert got == [1.0, None, 1.5, 2.0]


def test_savgol_reproduces_a_quadratic(spark):
    values = [0.5 * k * k - 3 * k + 1 for k in range(12)]
    got = [r.s for r in windows.savgol(frames(spark, values), "v", "k", "s").orderBy("frame").collect()]
    assert np.allclose(got, values)


def test_islands_and_run_lengths(spark):
    df = frames(spark, [1.0, 1.0, None, 2.0])
    assert sorted((r.start_frame, r.end_frame) for r in windows.islands(df, F.col("v").isNotNull(), "k").collect()) == [(0, 1), (3, 3)]


def test_unwrap_crosses_the_seam(spark):
    got = [r.u for r in windows.unwrapped(frames(spark, [170.0, -175.0, None, -160.0, 175.0]), "v", "k", "u").orderBy("frame").collect()]
    assert got == [170.0, 185.0, 200.0, 175.0]


def test_checkpoints_take_the_earlier_of_two(spark):
    df = frames(spark, [1.0, 1.0, None, None, 1.0, 1.0])
    r = windows.checkpoints(df, F.col("v").isNotNull(), "k").first()
    assert (r.first_frame, r.middle_frame, r.last_frame) == (0, 1, 5)
    assert windows.checkpoints(frames(spark, [1.0]), F.lit(True), "k").count() == 0


def test_uniform_segments_on_a_line(spark):
    got = [r.v for r in windows.uniform_segments(frames(spark, [float(k) for k in range(8)]), ("v",), "k").orderBy("segment").collect()]
    assert np.allclose(got, np.linspace(0, 7, 11))


def test_ransac_recovers_a_transform():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(60, 3))
    angle = math.radians(30)
    r = np.array([[math.cos(angle), -math.sin(angle), 0], [math.sin(angle), math.cos(angle), 0], [0, 0, 1]])
    b = a @ r.T + [1, 2, 3]
    b[:20] += rng.normal(size=(20, 3)) * 5
    got, t, rmse, good = robust.ransac_rigid(a, b, rounds=300)
    assert np.allclose(got, r, atol=1e-6) and np.allclose(t, [1, 2, 3], atol=1e-6) and rmse < 1e-6 and good.sum() >= 40
    assert robust.ransac_rigid(a[:2], b[:2]) is None


def test_plane_and_medians():
    rng = np.random.default_rng(2)
    plane = np.c_[rng.normal(size=(50, 1)), np.zeros(50), rng.normal(size=(50, 1))]
    up, share = robust.plane_up(plane)
    assert np.allclose(up, [0, -1, 0], atol=1e-9) and share == 1
    points = np.array([[0.0, 0, 0]] * 5 + [[100.0, 0, 0]])
    assert np.allclose(robust.geometric_median(points), 0, atol=1e-6)
    assert robust.farthest_points(np.array([[0.0, 0], [1, 0], [10, 0]]), 2).tolist() == [1, 2]


def test_water_fill(spark):
    df = spark.createDataFrame([("a", 3), ("b", 100), ("c", 100), ("d", 1)], "s string, n long")
    fill = lambda total: {r.s: r.quota for r in sampling.water_fill(df, "s", "n", total).collect()}
    assert fill(21) == {"a": 3, "b": 9, "c": 8, "d": 1}
    assert fill(4) == {"a": 1, "b": 1, "c": 1, "d": 1}
    assert fill(1000) == {"a": 3, "b": 100, "c": 100, "d": 1}


def test_sampling_does_not_depend_on_order(spark):
    df = spark.range(500)
    a = {r.id for r in sampling.uniform(df, 20, 3, "id").collect()}
    assert a == {r.id for r in sampling.uniform(df.orderBy(F.desc("id")).repartition(7), 20, 3, "id").collect()} and len(a) == 20


def test_flips_and_coverage(spark):
    df = spark.createDataFrame([("A", "B", "A"), (None, "A", "A"), ("B", "A", "B"), ("B", "C", "A")], "old string, new string, gt string")
    got = {r.flip: r.n for r in scoring.answer_flips(df, {"old": "old"}, "new", "gt").collect()}
    assert got == {"loss": 2, "gain": 1, "changed_wrong": 1}
    a, b = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("y",), ("z",)], "id string")
    assert {(r.id, r.problem) for r in scoring.coverage(a, b, "id").collect()} == {("x", "missing"), ("z", "extra")}


def test_actions(spark):
    text = 'so {bad {"x": {"action": "inner"}} then {"name": "b", "v": {"action": 1}} {"action": "c"}'
    got = actions.json_objects(text)
    assert [json.loads(v) for v, _, _ in got] == [{"action": "inner"}, {"name": "b", "v": {"action": 1}}, {"action": "c"}]
    assert all(json.loads(text[a:b]) for _, a, b in got)
    assert actions.only_field('{"a": 1, "b": 2} {"a": [3]}', "a") == "[3]"
    assert actions.numbers_of('{"a": [1, true, {"b": 2.5}], "c": "3"}') == [1.0, 2.5] and actions.numbers_of("no") is None


def test_calculator(spark):
    df = spark.createDataFrame([([3.0, 4.0], 2.0)], "v array<double>, k double")
    out = actions.compile_program("a = norm(v)\nb = a ** k + v[-1] - mean(v)\nc = path_length([[0, 0], [3, 4], [3, 5]])", {"v": F.col("v"), "k": F.col("k")})
    r = df.select(*(c.alias(n) for n, c in out.items())).first()
    assert (r.a, r.b, r.c) == (5.0, 25.5, 6.0)
    for bad in ("import os", "x = __import__('os')", "x = (lambda: 1)()", "x = y", "x = 'a'"):
        with pytest.raises(actions.CalculatorError):
            actions.compile_program(bad, {})


def test_state_machine_and_rules(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "a"), (1, 3, "assistant", "")], "conv_id long, turn long, role string, text string")
    codes = {(r.step, r.code) for r in audit.violations(df, audit.conversation_rules(), "conv_id", "turn").collect()}
    assert codes == {(1, "role_repeated"), (1, "repeated_text"), (3, "turn_gap"), (3, "empty_text")}


def test_sources(spark, tmp_path):
    csv = tmp_path / "q.csv"
    csv.write_text('relative_path,video_type,cate,question,options,GT,others\nset/a b.mp4,0.0,1,"what, now?","A: x; B: ""y"";",B,\nset/c.mp4,1,9,q,"A: x",A,\n')
    rows = readers.csv_questions(spark, str(csv), ("set",)).orderBy("csv_row_index").collect()
    assert [r.problems for r in rows] == [[], ["options", "answer", "category"]] and rows[0].option_map == {"A": "x", "B": '"y"'} and rows[0].dataset == "set"
    folder = tmp_path / "records"
    folder.mkdir()
    (folder / "a.json").write_text('{"question_id": "a", "v": 1}')
    (folder / "b.json").write_text('{"question_id": "other", "v": 2}')
    (folder / "c.json").write_text("{broken")
    (folder / "review_queue.json").write_text("{}")
    records = readers.json_records(spark, str(folder), "question_id string, v int")
    expected = spark.createDataFrame([("a",), ("d",)], "question_id string")
    got = {(r.key, r.code) for r in readers.record_violations(records, expected).collect()}
    assert got == {("c", "record_load_error"), ("b", "identity_mismatch"), ("b", "extra"), ("c", "extra"), ("d", "missing")}
    md = tmp_path / "t.md"
    md.write_text("# x\n\n## Scores\n\ntext\n\n| run | acc |\n| --- | --- |\n| **v1** | **66.5 %** |\n| v2 | — |\n\nfooter\n")
    cells = {(r["row"], r["name"]): (r.text, r.value, r.bold) for r in readers.markdown_table(spark, str(md), "## Scores").collect()}
    assert cells == {(0, "run"): ("v1", None, True), (0, "acc"): ("66.5 %", 66.5, True), (1, "run"): ("v2", None, False), (1, "acc"): (None, None, False)}
    lines = tmp_path / "r.jsonl"
    lines.write_text('{"custom_id": "1", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "{\\"choice\\": \\"Q\\"}"}}]}}}\n\n{"custom_id": "2", "error": {"m": 1}}\n')
    got = readers.batch_results(spark, str(lines)).select("id", "error", readers.labels("content", "choice", ("A",), "UNMAPPABLE").alias("l")).orderBy("id").collect()
    assert [(r.id, r.error, r.l) for r in got] == [("1", None, "UNMAPPABLE"), ("2", "request_error", "UNMAPPABLE")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "A", float("nan")), (2, "B", 1.0)], "i long, l string, v double")
    writers.write_records(df, str(tmp_path / "o"))
    assert {(r.i, r.v) for r in spark.read.schema("i long, v double").json(str(tmp_path / "o")).collect()} == {(0, None), (2, 1.0)}
    assert [(r.i, r.l) for r in writers.positional(df, "i", "l", 3).collect()] == [(0, "A"), (1, "E"), (2, "B"), (3, "E")]
    assert writers.markdown(df.select("i", "l").orderBy("i")).splitlines()[2:] == ["| 0 | A |", "| 2 | B |"]


def test_incremental_scores_equal_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k % 2 and "en" or "fr", "A" if k % 3 else "B", "A") for k in range(40)], "lang string, pred string, gt string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    run = lambda: incremental.score_stream(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "ck"), str(tmp_path / "out"))
    want = {(r.lang, r.n, r.correct) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("gt")).alias("correct")).collect()}
    assert {(r.lang, r.n, r.correct) for r in run().collect()} == want
    rows.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sum(r.n for r in run().collect()) == 41


def test_protocol_stream(spark, tmp_path):
    steps = ["choose_bucket", "choose_candidate", "name_subject", "choose_candidate", "final_answer"]
    df = spark.createDataFrame([(q, k, a) for q in (1, 2) for k, a in enumerate(steps)], "question_id long, step long, action string")
    df.write.parquet(str(tmp_path / "in"))
    out = incremental.check_protocol(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    run = out.writeStream.format("memory").queryName("protocol").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = [(r.step, r.accepted) for r in spark.sql("select * from protocol where question_id = 1 order by step").collect()]
    assert got == [(0, True), (1, False), (2, True), (3, True), (4, True)]


# ---- text functions: more of their cases ----


def test_options_with_any_letter_and_lines(spark):
    got = one(spark, tx.option_list_map("t"), t=["q: x\ny ", "second", " A) z"])
    assert got == {"Q": "x\ny", "B": "second", "A": "z"}
    assert one(spark, tx.option_list_map("t"), t=["x", "A. y"]) == {"A": "x", "B": "A. y"}
    assert one(spark, tx.option_list_map("t"), t=["B. x", "y"]) == {"B": "y"}
    assert one(spark, tx.option_list_map("t"), t=list("stuvwxyzq")) is None


def test_letters_in_angles(spark):
    assert [one(spark, tx.choice_letter("t"), t=t) for t in ("<B because", "<b</answer>", "<Best", "< c", "<answer>D", "<Q> answer: a")] == ["B", "B", None, "C", None, "A"]


def test_slug_keeps_dots(spark):
    assert one(spark, tx.slug("t"), t="Set A/my.clip v2.mp4").startswith("set_a_my.clip_v2_")


def test_subject_keys(spark):
    keys = [one(spark, tx.subject_key(F.lit(t).cast("string"))) for t in (None, "", "  The Dog's  ", "the dog's", "Ünter - x")]
    assert keys[:2] == ["camera_only"] * 2 and keys[2] == keys[3] and keys[2].startswith("the_dog_s_") and keys[4].startswith("ünter___x_")


def test_normal_keys(spark):
    got = [one(spark, tx.normal_key(F.lit(t).cast("string"))) for t in (" A\t B ", "Stra\u00dfe", "\ufb01n\u3000 X", "e\u0301", "\u0130", None)]
    assert got == ["a b", "strasse", "fin x", "\u00e9", "i\u0307", None]


# ---- more sources, sinks and runs ----


def test_question_files_are_numbered_each_by_itself(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("relative_path,video_type,cate,question,options,GT,others\n" + "".join(f'{name}/{k}.mp4,0,1,"q, ""{k}""","A: x; B: y",A,\n' for k in range(5)))
    rows = readers.csv_questions(spark, str(tmp_path)).collect()
    assert sorted((r.dataset, r.csv_row_index, r.relative_path) for r in rows) == [(n, k, f"{n}/{k}.mp4") for n in "ab" for k in range(5)]


def test_tensor_files(spark, tmp_path):
    np.savez_compressed(tmp_path / "t.npz", xyz=np.arange(6.0).reshape(2, 3), one=np.array([np.nan]), other=np.zeros(2))
    rows = readers.npz_values(spark, f"{tmp_path}/*.npz", ("xyz", "one", "absent")).collect()
    assert sorted((r.name, tuple(r["index"]), r.value) for r in rows if r.name == "xyz") == [("xyz", (i, j), float(3 * i + j)) for i in range(2) for j in range(3)]
    assert [(r["index"], r.value) for r in rows if r.name == "one"] == [([0], None)] and len(rows) == 7
    table = spark.createDataFrame([(1, 2, float("nan")), (0, 1, 2.0)], "track int, frame int, x double")
    writers.write_tensors(table, f"{tmp_path}/out")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(0, 1, 2.0), (1, 2, None)]


def test_retention_and_provenance(spark, tmp_path):
    for name in ("frames", "masks", "summary"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.txt").write_text(name)
    assert writers.discard(spark, str(tmp_path), ("summary",)) == ["frames", "masks"]
    row = readers.provenance(spark, str(tmp_path / "summary")).first()
    assert row.length == 7 and row.application and row.spark_version == spark.version


def test_reports_of_small_tables(spark):
    df = spark.createDataFrame([(1, "a<b", 0.5), (2, None, None)], "k int, t string, v double").orderBy("k")
    assert writers.html(df) == "<table><tr><th>k</th><th>t</th><th>v</th></tr><tr><td>1</td><td>a&lt;b</td><td>0.500</td></tr><tr><td>2</td><td>-</td><td>-</td></tr></table>"
    assert writers.console(df).split("\n") == ["k  t    v", "1  a<b  0.500", "2  -    -"]
    assert writers.markdown(df, 1).endswith("(more rows follow)")


def test_responses_that_fail_stay_with_their_row(spark):
    def respond(pdf):
        return pdf.assign(out=[10 // x for x in pdf["x"]])

    rows = incremental.responder(spark.createDataFrame([(x,) for x in (1, 0, 5)], "x long").coalesce(1), respond, "x long, out long").collect()
    assert sorted((r.x, r.out, r.error) for r in rows if r.error is None) == [(1, 10, None), (5, 2, None)]
    assert [(r.x, r.out, r.error) for r in rows if r.error] == [(0, None, "ZeroDivisionError")]


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_of_few_keys(spark, accuracy):
    """Against numpy, with ties, one value, a null key and brackets so narrow that most rows lie outside."""
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=4001), "b": np.repeat([1.0, 2.0, 5.0], [10, 300, 7]), "c": np.array([3.5]), None: rng.integers(0, 9, 500).astype(float), "d": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: (r.q0, r.q1, r.q2, r.n) for r in robust.few_quantiles(df, "v", (0.5, 0.9, 0.013), "k", accuracy).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert np.allclose(got[k][:3], np.quantile(vs, [0.5, 0.9, 0.013])) and got[k][3] == len(vs)
    mads = {r.k: (r.center, r.sigma) for r in robust.few_mad(df.where("v is not null"), "v", "k").collect()}
    assert all(np.allclose(mads[k], (np.median(vs), 1.4826 * np.median(np.abs(vs - np.median(vs))))) for k, vs in groups.items())
