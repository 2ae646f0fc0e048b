"""Contracts of JSON records: each is a list of rules in order, and a record's verdict is the first that it breaks.

Rules are column expressions over a parsed variant, so a whole table is judged in one pass without Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, Column]]


class Record:
    """A JSON text, parsed once; paths as '$.a.b'."""

    def __init__(self, text: Column):
        self.text = text
        self.value = F.try_parse_json(text)

    def at(self, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(self.value, path, kind)

    def kind(self, path: str = "$") -> Column:
        """STRING, BIGINT, BOOLEAN, ..., ARRAY, OBJECT, VOID for null; null where nothing is there."""
        return F.regexp_extract(F.schema_of_variant(self.at(path)), "^[A-Z]+", 0)

    def has(self, path: str) -> Column:
        return self.at(path).isNotNull()

    def is_object(self, path: str = "$") -> Column:
        return F.coalesce(self.kind(path) == "OBJECT", F.lit(False))

    def is_list(self, path: str) -> Column:
        return F.coalesce(self.kind(path) == "ARRAY", F.lit(False))

    def is_string(self, path: str) -> Column:
        return F.coalesce(self.kind(path) == "STRING", F.lit(False))

    def is_integer(self, path: str) -> Column:
        return F.coalesce(self.kind(path) == "BIGINT", F.lit(False))

    def is_number(self, path: str) -> Column:
        return F.coalesce(self.kind(path).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.lit(False))

    def filled(self, path: str) -> Column:
        """A string with something besides white space."""
        return self.is_string(path) & (F.trim(self.string(path)) != "")

    def string(self, path: str) -> Column:
        return F.coalesce(self.at(path, "string"), F.lit(""))

    def within(self, path: str, low: int, high: int) -> Column:
        return self.is_integer(path) & F.coalesce(self.at(path, "bigint").between(low, high), F.lit(False))

    def items(self, path: str) -> Column:
        """The items of a list as variants; none where there is no list."""
        return F.coalesce(F.try_variant_get(self.value, path, "array<variant>"), F.array().cast("array<variant>"))

    def keys(self, path: str) -> Column:
        return F.coalesce(F.json_object_keys(F.get_json_object(self.text, path)), F.array().cast("array<string>"))

    def only(self, path: str, *names: str) -> Column:
        return F.size(F.array_except(self.keys(path), F.array(*map(F.lit, names)))) == 0


def kind_of(item: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(item), "^[A-Z]+", 0)


def verdict(rules: Rules) -> Column:
    """The first rule that is broken, or 'ok'; a condition that is null is not broken."""
    return F.coalesce(*(F.when(bad, F.lit(code)) for code, bad in rules), F.lit("ok"))


def under(condition: Column, rules: Rules) -> Rules:
    return [(code, condition & bad) for code, bad in rules]


def all_strings(record: Record, path: str) -> Column:
    return F.forall(record.items(path), lambda x: F.coalesce(kind_of(x) == "STRING", F.lit(False)))


def frame_ok(item: Column, frames: int) -> Column:
    return F.coalesce((kind_of(item) == "BIGINT") & F.try_variant_get(item, "$", "bigint").between(0, frames - 1), F.lit(False))


def repeated(record: Record, path: str) -> Column:
    """Whether a list of strings or integers holds a value twice, strings without outer white space."""
    plain = F.transform(record.items(path), lambda x: F.trim(F.try_variant_get(x, "$", "string")))
    return F.size(F.array_distinct(plain)) != F.size(plain)


#: Names of measurements, and the limits of the two action formats.
BUCKETS = ("traj_subject_own_frame", "traj_camera_own_frame", "sub_obs_distance_change", "orient_camera_subject_frame")
SUBJECT_WORDS, TEXT_CHARS, REASON_CHARS, FRAMES, POINTS = 5, 2000, 500, 32, 8


def choice_action(text: Column) -> Column:
    """Verdict on the four actions by which an agent chooses a measurement, a subject and a candidate, and answers."""
    r = Record(text)
    a = "$.arguments"
    name = F.coalesce(F.nullif(r.string("$.action"), F.lit("")), F.nullif(r.string("$.name"), F.lit("")))
    words = F.size(F.filter(F.split(r.string(f"{a}.subject"), r"\s+"), lambda w: w != ""))
    nothing = ~r.has(a) | (r.kind(a) == "VOID")
    return verdict([
        ("not_an_object", ~r.is_object()),
        ("unknown_action", ~F.coalesce(name.isin("choose_bucket", "name_subject", "choose_candidate", "final_answer"), F.lit(False))),
        ("arguments_not_an_object", ~nothing & ~r.is_object(a)),
        ("no_justification", ~r.filled(f"{a}.justification")),
        *under(name == "choose_bucket", [("unknown_field", ~r.only(a, "bucket", "justification")), ("unknown_bucket", ~r.string(f"{a}.bucket").isin(*BUCKETS))]),
        *under(name == "name_subject", [("unknown_field", ~r.only(a, "subject", "justification")), ("no_subject", ~r.filled(f"{a}.subject")), ("subject_too_long", words > SUBJECT_WORDS)]),
        *under(name == "choose_candidate", [("unknown_field", ~r.only(a, "index", "justification")), ("index_not_an_integer", ~r.is_integer(f"{a}.index"))]),
        *under(name == "final_answer", [
            ("unknown_field", ~r.only(a, "kind", "text", "justification", "limitations")),
            ("kind_not_text", r.has(f"{a}.kind") & (~r.is_string(f"{a}.kind") | (r.string(f"{a}.kind") != "text"))),
            ("no_text", ~r.filled(f"{a}.text")),
            ("text_too_long", F.length(r.string(f"{a}.text")) > TEXT_CHARS),
            ("limitations_not_text", r.has(f"{a}.limitations") & (r.kind(f"{a}.limitations") != "VOID") & ~r.is_string(f"{a}.limitations")),
        ]),
    ])


def tool_action(text: Column) -> Column:
    """Verdict on the four actions of the tool-using format; no action may name the host's point policy at any depth."""
    r = Record(text)
    a = "$.arguments"
    name = F.when(r.has("$.action"), r.at("$.action", "string")).otherwise(r.at("$.name", "string"))
    reason = [("no_justification", ~r.filled(f"{a}.justification")), ("justification_too_long", F.length(r.string(f"{a}.justification")) > REASON_CHARS)]
    mode, kind = r.string(f"{a}.mode"), F.when(r.has(f"{a}.kind"), r.string(f"{a}.kind")).otherwise("numeric")
    cited = r.has(f"{a}.evidence_ids")
    number = F.try_to_number(r.string(f"{a}.value"), F.lit("S999999999D999999")).cast("double")
    number = F.coalesce(r.at(f"{a}.value", "double"), number)
    return verdict([
        ("not_an_object", ~r.is_object()),
        ("host_policy", text.rlike(r'"point_mode"\s*:')),
        ("unsupported_action", ~F.coalesce(name.isin("ground_with_qwen", "query_d4rt", "python_math", "final_answer"), F.lit(False))),
        ("arguments_not_an_object", ~r.is_object(a)),
        *under(name == "ground_with_qwen", [
            ("unknown_field", ~r.only(a, "mode", "t_src", "request", "count", "justification")), *reason,
            ("mode", ~r.is_string(f"{a}.mode") | ~mode.isin("bbox", "points")),
            ("no_request", ~r.filled(f"{a}.request")), ("request_too_long", F.length(r.string(f"{a}.request")) > REASON_CHARS), ("source_frame", ~r.within(f"{a}.t_src", 0, FRAMES - 1)),
            ("count_in_bbox_mode", (mode == "bbox") & r.has(f"{a}.count")), ("no_count", (mode == "points") & ~r.is_integer(f"{a}.count")), ("count_range", (mode == "points") & ~r.within(f"{a}.count", 1, POINTS)),
        ]),
        *under(name == "query_d4rt", [
            ("unknown_field", ~r.only(a, "grounding_id", "point_ids", "t_tgt", "t_cam", "justification")), *reason,
            ("no_grounding_id", ~r.filled(f"{a}.grounding_id")),
            ("point_ids", r.has(f"{a}.point_ids") & (r.kind(f"{a}.point_ids") != "VOID") & (~r.is_list(f"{a}.point_ids") | (F.size(r.items(f"{a}.point_ids")) == 0) | ~all_strings(r, f"{a}.point_ids"))),
            ("point_ids_repeat", r.is_list(f"{a}.point_ids") & repeated(r, f"{a}.point_ids")),
            ("no_targets", ~r.is_list(f"{a}.t_tgt") | (F.size(r.items(f"{a}.t_tgt")) == 0)),
            ("target_frame", ~F.forall(r.items(f"{a}.t_tgt"), lambda x: frame_ok(x, FRAMES))),
            ("targets_repeat", repeated(r, f"{a}.t_tgt")), ("camera_frame", ~r.within(f"{a}.t_cam", 0, FRAMES - 1)),
        ]),
        *under(name == "python_math", [("unknown_field", ~r.only(a, "bindings", "code", "justification")), *reason, ("bindings_not_an_object", ~r.is_object(f"{a}.bindings")), ("no_code", ~r.filled(f"{a}.code"))]),
        *under(name == "final_answer", [
            ("unknown_field", ~r.only(a, "kind", "value", "unit", "text", "evidence_ids", "limitations")),
            ("kind", ~kind.isin("numeric", "text")),
            ("evidence_not_strings", F.when(cited, ~r.is_list(f"{a}.evidence_ids") | ~all_strings(r, f"{a}.evidence_ids")).otherwise(kind == "numeric")),
            ("no_evidence", (kind == "numeric") & (F.size(r.items(f"{a}.evidence_ids")) == 0)),
            ("limitations_not_text", r.has(f"{a}.limitations") & ~r.is_string(f"{a}.limitations")),
            ("no_value", (kind == "numeric") & number.isNull()), ("no_unit", (kind == "numeric") & ~r.filled(f"{a}.unit")),
            ("no_text", (kind == "text") & ~r.filled(f"{a}.text")), ("text_too_long", (kind == "text") & (F.length(r.string(f"{a}.text")) > TEXT_CHARS)),
        ]),
    ])


def box(text: Column, field: str = "bbox_2d_1000") -> tuple[Column, Column]:
    """(verdict, box): null, or four finite numbers in 0..1000 with positive width and height."""
    r = Record(text)
    at = f"$.{field}"
    values = F.transform(r.items(at), lambda x: F.try_variant_get(x, "$", "double"))
    numbers = F.forall(r.items(at), lambda x: F.coalesce(kind_of(x).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.lit(False)))
    none = r.kind(at) == "VOID"
    e = lambda k: F.get(values, F.lit(k))
    code = F.when(none, "not_found").otherwise(verdict([
        ("no_field", ~r.is_object() | ~r.has(at) | (F.size(r.keys("$")) != 1)), ("not_four_numbers", ~r.is_list(at) | (F.size(values) != 4)), ("not_numbers", ~numbers),
        ("out_of_range", ~F.forall(values, lambda x: x.between(0, 1000))), ("no_area", (e(2) <= e(0)) | (e(3) <= e(1))),
    ]))
    return code, F.when(code == "ok", values)


def points(text: Column, count: Column, field: str = "points_2d_1000", chars: int = 200) -> tuple[Column, Column]:
    """(verdict, points): null or empty, or at most `count` unique points in 0..1000, each with a short description."""
    r = Record(text)
    at = f"$.{field}"
    items = F.coalesce(F.from_json(F.get_json_object(text, at), "array<struct<xy:array<double>,description:string>>"), F.array().cast("array<struct<xy:array<double>,description:string>>"))
    raw = r.items(at)
    typed = F.forall(raw, lambda x: F.coalesce((F.regexp_extract(F.schema_of_variant(F.try_variant_get(x, "$.xy", "variant")), r"^ARRAY<(BIGINT|DECIMAL\([0-9,]+\)|DOUBLE)>$", 0) != "") & (kind_of(F.try_variant_get(x, "$.description", "variant")) == "STRING"), F.lit(False)))
    code = F.when((r.kind(at) == "VOID") | (r.is_list(at) & (F.size(raw) == 0)), "not_found").otherwise(verdict([
        ("no_field", ~r.is_object() | ~r.has(at) | (F.size(r.keys("$")) != 1)), ("not_a_list", ~r.is_list(at)), ("too_many", F.size(raw) > count),
        ("malformed_point", ~typed | ~F.forall(items, lambda p: F.size(p["xy"]) == 2)),
        ("out_of_range", ~F.forall(items, lambda p: F.forall(p["xy"], lambda v: v.between(0, 1000)))),
        ("repeated_point", F.size(F.array_distinct(F.transform(items, lambda p: p["xy"]))) != F.size(items)),
        ("description", F.exists(items, lambda p: (F.trim(p["description"]) == "") | (F.length(F.trim(p["description"])) > chars))),
    ]))
    return code, F.when(code == "ok", items)


def legacy_query(text: Column) -> Column:
    """An older query action with its box, frames as integers, as JSON; null for any other or one that does not fit."""
    r = Record(text)
    a = "$.arguments"
    name = F.coalesce(r.at("$.action", "string"), r.at("$.name", "string"))
    numbers = lambda path, kind: F.transform(r.items(path), lambda x: F.try_variant_get(x, "$", kind))
    values, targets = numbers(f"{a}.bbox_2d_1000", "double"), numbers(f"{a}.t_tgt", "bigint")
    source, camera = r.at(f"{a}.t_src", "bigint"), r.at(f"{a}.t_cam", "bigint")
    whole = F.forall(values, lambda x: x.isNotNull()) & F.forall(targets, lambda x: x.isNotNull()) & source.isNotNull() & camera.isNotNull()
    fits = (name == "query_d4rt") & r.is_list(f"{a}.bbox_2d_1000") & ~r.has(f"{a}.grounding_id") & r.is_list(f"{a}.t_tgt") & whole
    return F.when(fits, F.to_json(F.struct(values.alias("bbox_2d_1000"), source.alias("t_src"), targets.alias("t_tgt"), camera.alias("t_cam"))))


def cited_evidence(text: Column) -> Column:
    """The ids that an action refers to, each once, in order: a query's grounding, the bindings of a calculation, the citations of an answer."""
    r = Record(text)
    name = F.coalesce(r.at("$.action", "string"), r.at("$.name", "string"))
    none = F.array().cast("array<string>")
    bindings = F.map_values(F.coalesce(F.try_variant_get(r.value, "$.arguments.bindings", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    string = lambda x: F.when(kind_of(x) == "STRING", F.try_variant_get(x, "$", "string"))
    found = (
        F.when((name == "query_d4rt") & r.is_string("$.arguments.grounding_id"), F.array(r.at("$.arguments.grounding_id", "string")))
        .when(name == "python_math", F.transform(bindings, lambda b: string(F.try_variant_get(b, "$.evidence_id", "variant"))))
        .when(name == "final_answer", F.transform(r.items("$.arguments.evidence_ids"), string))
        .otherwise(none)
    )
    return F.array_sort(F.array_distinct(F.array_compact(found)))
