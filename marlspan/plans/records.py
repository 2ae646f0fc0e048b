"""Queries over JSON records: action contracts, replies with boxes and points, older shapes, citations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts
from ..session import table
from .registry import query

_J = {"justification": "because"}


def _act(name: str, **arguments) -> str:
    return json.dumps({"action": name, "arguments": arguments})


CHOICES = (
    _act("choose_bucket", bucket="traj_camera_own_frame", **_J), _act("choose_bucket", bucket="traj", **_J), _act("choose_bucket", bucket="sub_obs_distance_change"), _act("choose_bucket", bucket="traj_camera_own_frame", extra=1, **_J),
    _act("name_subject", subject="the small brown dog", **_J), _act("name_subject", subject=" a  very small brown dog ", **_J), _act("name_subject", subject="one two three four five six", **_J), _act("name_subject", subject="  ", **_J), _act("name_subject", subject=5, **_J),
    _act("choose_candidate", index=2, **_J), _act("choose_candidate", index=True, **_J), _act("choose_candidate", index=2.5, **_J), _act("choose_candidate", index="2", **_J),
    _act("final_answer", text="B. left", **_J), _act("final_answer", kind="numeric", text="B", **_J), _act("final_answer", text="x" * 2001, **_J), _act("final_answer", text="B", limitations=None, **_J), _act("final_answer", text="B", limitations=[1], **_J), _act("final_answer", text="", **_J),
    '{"name": "choose_candidate", "arguments": {"index": 1, "justification": "x"}}', '{"action": "", "name": "choose_candidate", "arguments": {"index": 1, "justification": " "}}', '{"action": "fly"}', '{"action": "name_subject"}', '{"action": "name_subject", "arguments": [1]}', "[1, 2]", '"text"', "not json",
)
_G = {"mode": "bbox", "t_src": 3, "request": "the dog", **_J}
_D = {"grounding_id": "g_1", "t_tgt": [0, 31], "t_cam": 0, **_J}
TOOLS = (
    _act("ground_with_qwen", **_G), _act("ground_with_qwen", **_G | {"mode": "mask"}), _act("ground_with_qwen", **_G | {"request": " "}), _act("ground_with_qwen", **_G | {"request": "r" * 501}), _act("ground_with_qwen", **_G | {"t_src": 32}), _act("ground_with_qwen", **_G | {"t_src": True}),
    _act("ground_with_qwen", **_G | {"count": 1}), _act("ground_with_qwen", **_G | {"mode": "points"}), _act("ground_with_qwen", **_G | {"mode": "points", "count": 8}), _act("ground_with_qwen", **_G | {"mode": "points", "count": 9}), _act("ground_with_qwen", **_G | {"justification": "j" * 501}), _act("ground_with_qwen", **_G | {"x": 1}),
    _act("query_d4rt", **_D), _act("query_d4rt", **_D | {"grounding_id": ""}), _act("query_d4rt", **_D | {"point_ids": ["a", "b"]}), _act("query_d4rt", **_D | {"point_ids": ["a", " a"]}), _act("query_d4rt", **_D | {"point_ids": []}), _act("query_d4rt", **_D | {"point_ids": [1]}), _act("query_d4rt", **_D | {"point_ids": None}),
    _act("query_d4rt", **_D | {"t_tgt": []}), _act("query_d4rt", **_D | {"t_tgt": [1, 1]}), _act("query_d4rt", **_D | {"t_tgt": [1, 32]}), _act("query_d4rt", **_D | {"t_tgt": [1.5]}), _act("query_d4rt", **_D | {"t_cam": -1}), _act("query_d4rt", **_D | {"meta": {"deep": [{"point_mode": "x"}]}}),
    _act("python_math", bindings={}, code="a = 1", **_J), _act("python_math", bindings=[], code="a = 1", **_J), _act("python_math", bindings={}, code=" ", **_J), _act("python_math", bindings={}, code="a", justification='said "point_mode": no'),
    _act("final_answer", value=2.5, unit="m", evidence_ids=["math_1"]), _act("final_answer", value=2.5, unit="m", evidence_ids=[]), _act("final_answer", value=2.5, unit="m"), _act("final_answer", unit="m", evidence_ids=["math_1"]), _act("final_answer", value=1, unit=" ", evidence_ids=["math_1"]), _act("final_answer", value=1, unit="m", evidence_ids=[1]),
    _act("final_answer", kind="text", text="left"), _act("final_answer", kind="text", text=""), _act("final_answer", kind="text", text="t" * 2001), _act("final_answer", kind="image", text="t"), _act("final_answer", kind="text", text="t", limitations=3), _act("stop"), '{"action": "python_math"}', "3",
)


def _literal(cases: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in cases) + "]"


def chosen(spark: SparkSession, sf_dir: str, cases: tuple[str, ...]) -> DataFrame:
    """A record for each turn of a conversation: a shape by its number, in which reasons and descriptions are the turn's whole text, and a coordinate and an index follow its length."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("record_id"), F.coalesce("text", F.lit("")).alias("text"))
    shape = F.get(F.array(*map(F.lit, cases)), (F.col("record_id") % len(cases)).cast("int"))
    said = F.to_json(F.struct("text"))
    said = F.substring(said, F.lit(9), F.length(said) - 9)
    size = F.length("text")
    return rows.select("record_id", F.replace(F.replace(F.replace(F.replace(shape, F.lit('"because"'), said), F.lit('"nose"'), said), F.lit("300.5"), (size % 1300).cast("string")), F.lit("31"), (size % 40).cast("string")).alias("t"))


def _from(cases: tuple[str, ...]) -> str:
    shape = f"l[record_id % {len(cases)} + 1]"
    filled = f"""replace(replace(replace(replace({shape}, '"because"', said), '"nose"', said), '300.5', (size % 1300)::varchar), '31', (size % 40)::varchar)"""
    return f"with l as (select {_literal(cases)} as l), texts as (select conv_id * 1000 + turn as record_id, to_json(coalesce(text, ''))::varchar as said, length(coalesce(text, '')) as size from conversations), c as (select record_id, {filled} as t from texts, l), j as (select record_id, t, case when json_valid(t) then t::json end as j from c), k as (select *, json_type(j) as root, json_extract(j, '$.arguments') as a from j), "


def _text(field: str) -> str:
    return f"(json_type(a, '$.{field}') is not distinct from 'VARCHAR' and trim(json_extract_string(a, '$.{field}')) <> '')"


def _unknown(*names: str) -> str:
    return f"len(list_filter(json_keys(a), lambda x: x not in ({', '.join(repr(n) for n in names)}))) > 0"


_INT = "('BIGINT', 'UBIGINT')"


@query(
    _from(CHOICES)
    + f"""n as (select *, coalesce(nullif(json_extract_string(j, '$.action'), ''), nullif(json_extract_string(j, '$.name'), '')) as name from k)
  select record_id, case when root is distinct from 'OBJECT' then 'not_an_object' when name is null or name not in ('choose_bucket', 'name_subject', 'choose_candidate', 'final_answer') then 'unknown_action'
    when a is not null and json_type(a) not in ('OBJECT', 'NULL') then 'arguments_not_an_object' when not {_text('justification')} then 'no_justification'
    when name = 'choose_bucket' then case when {_unknown('bucket', 'justification')} then 'unknown_field' when coalesce(json_extract_string(a, '$.bucket'), '') not in ('traj_subject_own_frame', 'traj_camera_own_frame', 'sub_obs_distance_change', 'orient_camera_subject_frame') then 'unknown_bucket' else 'ok' end
    when name = 'name_subject' then case when {_unknown('subject', 'justification')} then 'unknown_field' when not {_text('subject')} then 'no_subject' when len(string_split_regex(trim(json_extract_string(a, '$.subject')), '\\s+')) > 5 then 'subject_too_long' else 'ok' end
    when name = 'choose_candidate' then case when {_unknown('index', 'justification')} then 'unknown_field' when coalesce(json_type(a, '$.index'), '') not in {_INT} then 'index_not_an_integer' else 'ok' end
    else case when {_unknown('kind', 'text', 'justification', 'limitations')} then 'unknown_field' when coalesce(json_extract_string(a, '$.kind'), 'text') <> 'text' then 'kind_not_text' when not {_text('text')} then 'no_text'
      when length(json_extract_string(a, '$.text')) > 2000 then 'text_too_long' when coalesce(json_type(a, '$.limitations'), 'NULL') not in ('NULL', 'VARCHAR') then 'limitations_not_text' else 'ok' end end as verdict from n"""
)
def choice_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir, CHOICES).select("record_id", contracts.choice_action(F.col("t")).alias("verdict"))


_REASON = f"when not {_text('justification')} then 'no_justification' when length(json_extract_string(a, '$.justification')) > 500 then 'justification_too_long'"
_FRAME = "coalesce(json_type(a, '$.{0}'), '') not in " + _INT + " or json_extract(a, '$.{0}')::bigint not between 0 and 31"


@query(
    _from(TOOLS)
    + f"""n as (select *, coalesce(json_extract_string(j, '$.action'), json_extract_string(j, '$.name')) as name, coalesce(json_extract_string(a, '$.kind'), 'numeric') as kind, json_extract_string(a, '$.mode') as mode from k)
  select record_id, case when root is distinct from 'OBJECT' then 'not_an_object' when len(json_extract(j, '$..point_mode')) > 0 then 'host_policy' when name is null or name not in ('ground_with_qwen', 'query_d4rt', 'python_math', 'final_answer') then 'unsupported_action'
    when a is null or json_type(a) <> 'OBJECT' then 'arguments_not_an_object'
    when name = 'ground_with_qwen' then case when {_unknown('mode', 't_src', 'request', 'count', 'justification')} then 'unknown_field' {_REASON} when coalesce(mode, '') not in ('bbox', 'points') then 'mode' when not {_text('request')} then 'no_request' when length(json_extract_string(a, '$.request')) > 500 then 'request_too_long'
      when {_FRAME.format('t_src')} then 'source_frame' when mode = 'bbox' and json_type(a, '$.count') is not null then 'count_in_bbox_mode' when mode = 'points' and coalesce(json_type(a, '$.count'), '') not in {_INT} then 'no_count' when mode = 'points' and json_extract(a, '$.count')::bigint not between 1 and 8 then 'count_range' else 'ok' end
    when name = 'query_d4rt' then case when {_unknown('grounding_id', 'point_ids', 't_tgt', 't_cam', 'justification')} then 'unknown_field' {_REASON} when not {_text('grounding_id')} then 'no_grounding_id'
      when coalesce(json_type(a, '$.point_ids'), 'NULL') not in ('NULL', 'ARRAY') or (json_type(a, '$.point_ids') = 'ARRAY' and (json_array_length(a, '$.point_ids') = 0 or len(list_filter(json_extract(a, '$.point_ids[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0)) then 'point_ids'
      when json_type(a, '$.point_ids') = 'ARRAY' and len(list_distinct(list_transform(json_extract_string(a, '$.point_ids[*]'), lambda x: trim(x)))) < json_array_length(a, '$.point_ids') then 'point_ids_repeat'
      when coalesce(json_type(a, '$.t_tgt'), '') <> 'ARRAY' or json_array_length(a, '$.t_tgt') = 0 then 'no_targets' when len(list_filter(json_extract(a, '$.t_tgt[*]'), lambda x: json_type(x) not in {_INT} or x::double not between 0 and 31)) > 0 then 'target_frame'
      when len(list_distinct(json_extract_string(a, '$.t_tgt[*]'))) < json_array_length(a, '$.t_tgt') then 'targets_repeat' when {_FRAME.format('t_cam')} then 'camera_frame' else 'ok' end
    when name = 'python_math' then case when {_unknown('bindings', 'code', 'justification')} then 'unknown_field' {_REASON} when coalesce(json_type(a, '$.bindings'), '') <> 'OBJECT' then 'bindings_not_an_object' when not {_text('code')} then 'no_code' else 'ok' end
    else case when {_unknown('kind', 'value', 'unit', 'text', 'evidence_ids', 'limitations')} then 'unknown_field' when kind not in ('numeric', 'text') then 'kind'
      when (json_type(a, '$.evidence_ids') is null and kind = 'numeric') or (json_type(a, '$.evidence_ids') is not null and (json_type(a, '$.evidence_ids') <> 'ARRAY' or len(list_filter(json_extract(a, '$.evidence_ids[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0)) then 'evidence_not_strings'
      when kind = 'numeric' and json_array_length(a, '$.evidence_ids') = 0 then 'no_evidence' when coalesce(json_type(a, '$.limitations'), 'VARCHAR') <> 'VARCHAR' then 'limitations_not_text' when kind = 'numeric' and try_cast(json_extract_string(a, '$.value') as double) is null then 'no_value'
      when kind = 'numeric' and not {_text('unit')} then 'no_unit' when kind = 'text' and not {_text('text')} then 'no_text' when kind = 'text' and length(json_extract_string(a, '$.text')) > 2000 then 'text_too_long' else 'ok' end end as verdict from n"""
)
def tool_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir, TOOLS).select("record_id", contracts.tool_action(F.col("t")).alias("verdict"))


def _box(value) -> str:
    return json.dumps({"bbox_2d_1000": value})


BOXES = (_box([10, 20, 300.5, 400]), _box(None), _box([10, 20, 10, 400]), _box([10, 20, 300]), _box([10, 20, 1000.5, 40]), _box([-1, 0, 5, 5]), _box([True, 0, 5, 5]), _box(["1", 0, 5, 5]), _box("no"), '{"bbox_2d_1000": [1, 2, 3, 4], "x": 1}', "[]", "no json")


@query(
    _from(BOXES)
    + """v as (select *, json_extract(j, '$.bbox_2d_1000') as b from k), w as (select record_id, case when root is distinct from 'OBJECT' or b is null then 'no_field' when json_type(b) = 'NULL' then 'not_found' when len(json_keys(j)) <> 1 then 'no_field' when json_type(b) <> 'ARRAY' or json_array_length(b) <> 4 then 'not_four_numbers'
    when len(list_filter(json_extract(b, '$[*]'), lambda x: json_type(x) not in ('BIGINT', 'UBIGINT', 'DOUBLE'))) > 0 then 'not_numbers' when len(list_filter(json_extract(b, '$[*]'), lambda x: x::double not between 0 and 1000)) > 0 then 'out_of_range'
    when json_extract(b, '$[2]')::double <= json_extract(b, '$[0]')::double or json_extract(b, '$[3]')::double <= json_extract(b, '$[1]')::double then 'no_area' else 'ok' end as verdict, b from v)
  select record_id, verdict, case when verdict = 'ok' then round((json_extract(b, '$[2]')::double - json_extract(b, '$[0]')::double) * (json_extract(b, '$[3]')::double - json_extract(b, '$[1]')::double), 3) end as area from w"""
)
def box_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with a box: the verdict, and the box's area."""
    code, values = contracts.box(F.col("t"))
    rows = chosen(spark, sf_dir, BOXES).select("record_id", code.alias("verdict"), values.alias("b"))
    at = lambda k: F.get("b", F.lit(k))
    return rows.select("record_id", "verdict", F.round((at(2) - at(0)) * (at(3) - at(1)), 3).alias("area"))


def _points(*p) -> str:
    return json.dumps({"points_2d_1000": [{"xy": list(xy), "description": d} for xy, d in p]})


POINT_REPLIES = (
    _points(((1, 2), "nose"), ((3.5, 4), "tail")), _points(((1, 2), "nose"), ((1, 2), "tail")), _points(((1, 2), "a"), ((2, 2), "b"), ((3, 2), "c")), _points(((1, 2), " ")), _points(((1, 2), "d" * 201)), _points(((1, 2, 3), "x")), _points(((1, 2000), "x")),
    _points(), '{"points_2d_1000": null}', '{"points_2d_1000": {"xy": [1, 2]}}', '{"points_2d_1000": [{"xy": [1, 2]}]}', '{"points_2d_1000": [{"xy": ["1", 2], "description": "x"}]}', '{"other": 1}', "no",
)


@query(
    _from(POINT_REPLIES)
    + """v as (select *, json_extract(j, '$.points_2d_1000') as b from k), w as (select record_id, b, case when root is distinct from 'OBJECT' or b is null then 'no_field' when json_type(b) = 'NULL' or (json_type(b) = 'ARRAY' and json_array_length(b) = 0) then 'not_found' when json_type(b) <> 'ARRAY' then 'not_a_list' when json_array_length(b) > 2 then 'too_many'
    when len(list_filter(json_extract(b, '$[*]'), lambda x: coalesce(json_array_length(x, '$.xy'), 0) <> 2 or coalesce(json_type(x, '$.description'), '') <> 'VARCHAR' or len(list_filter(json_extract(x, '$.xy[*]'), lambda y: json_type(y) not in ('BIGINT', 'UBIGINT', 'DOUBLE'))) > 0)) > 0 then 'malformed_point'
    when len(list_filter(json_extract(b, '$[*].xy[*]'), lambda x: x::double not between 0 and 1000)) > 0 then 'out_of_range' when len(list_distinct(list_transform(json_extract(b, '$[*].xy'), lambda x: x::varchar))) < json_array_length(b) then 'repeated_point'
    when len(list_filter(json_extract_string(b, '$[*].description'), lambda x: trim(x) = '' or length(trim(x)) > 200)) > 0 then 'description' else 'ok' end as verdict from v)
  select record_id, verdict, case when verdict = 'ok' then json_array_length(b)::bigint end as n from w"""
)
def points_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with at most two points."""
    code, items = contracts.points(F.col("t"), F.lit(2))
    rows = chosen(spark, sf_dir, POINT_REPLIES).select("record_id", code.alias("verdict"), items.alias("p"))
    return rows.select("record_id", "verdict", F.when(F.col("verdict") == "ok", F.size("p").cast("long")).alias("n"))


_OLD = {"bbox_2d_1000": [1, 2.5, 3, 4], "t_src": 0, "t_tgt": [1, 2], "t_cam": 0}
ACTIONS = (
    _act("query_d4rt", **_OLD), _act("query_d4rt", **_OLD | {"t_src": "5"}), _act("query_d4rt", **_OLD | {"t_tgt": ["x"]}), _act("query_d4rt", **_OLD | {"grounding_id": "g_1"}), _act("query_d4rt", grounding_id="g_2", t_tgt=[1], t_cam=0), _act("python_math", **_OLD),
    _act("python_math", bindings={"a": {"evidence_id": "d_1"}, "b": {"evidence_id": "d_2", "path": []}, "c": {"evidence_id": 4}, "d": 3, "e": {"evidence_id": "d_1"}}), _act("final_answer", evidence_ids=["m_1", 2, "d_1", "m_1"]), _act("final_answer", evidence_ids="m_1"), _act("stop"), "{}", "no json",
)


@query(
    _from(ACTIONS)
    + """n as (select *, coalesce(json_extract_string(j, '$.action'), json_extract_string(j, '$.name')) as name from k), o as (select record_id, a, list_transform(json_extract_string(a, '$.bbox_2d_1000[*]'), lambda x: try_cast(x as double)) as b, list_transform(json_extract_string(a, '$.t_tgt[*]'), lambda x: try_cast(x as bigint)) as g,
    try_cast(json_extract_string(a, '$.t_src') as bigint) as s, try_cast(json_extract_string(a, '$.t_cam') as bigint) as c, name = 'query_d4rt' and json_type(a, '$.bbox_2d_1000') = 'ARRAY' and json_type(a, '$.t_tgt') = 'ARRAY' and json_type(a, '$.grounding_id') is null as old from n)
  select record_id, case when old and s is not null and c is not null and len(list_filter(b, lambda x: x is null)) = 0 and len(list_filter(g, lambda x: x is null)) = 0 then list_sum(b) end as box_sum, case when old and s is not null and c is not null and len(list_filter(b, lambda x: x is null)) = 0 and len(list_filter(g, lambda x: x is null)) = 0 then s + c + list_sum(g)::bigint end as frames from o"""
)
def legacy_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chosen(spark, sf_dir, ACTIONS).select("record_id", contracts.legacy_query(F.col("t")).alias("q"))
    q = F.from_json("q", "bbox_2d_1000 array<double>, t_src bigint, t_tgt array<bigint>, t_cam bigint")
    total = lambda a, zero: F.aggregate(a, zero, lambda x, y: x + y)
    return rows.select("record_id", total(q["bbox_2d_1000"], F.lit(0.0)).alias("box_sum"), (q["t_src"] + q["t_cam"] + total(q["t_tgt"], F.lit(0).cast("bigint"))).alias("frames"))


@query(
    _from(ACTIONS)
    + """n as (select *, coalesce(json_extract_string(j, '$.action'), json_extract_string(j, '$.name')) as name from k), r as (select record_id, case when name = 'query_d4rt' and json_type(a, '$.grounding_id') = 'VARCHAR' then [json_extract_string(a, '$.grounding_id')]
    when name = 'python_math' then list_transform(list_filter(json_extract(a, '$.bindings.*.evidence_id'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$')
    when name = 'final_answer' and json_type(a, '$.evidence_ids') = 'ARRAY' then list_transform(list_filter(json_extract(a, '$.evidence_ids[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') else [] end as ids from n)
  select record_id, array_to_string(list_sort(list_distinct(ids)), ',') as cited from r"""
)
def cited_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir, ACTIONS).select("record_id", F.array_join(contracts.cited_evidence(F.col("t")), ",").alias("cited"))
