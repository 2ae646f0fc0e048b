"""Audits: each rule is a condition over rows, which may look along the trace, or over a key's rows; all are judged in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .contracts import Record


@dataclass(frozen=True)
class Rule:
    """code: of the violation; bad: a condition of a row, or, if whole, an aggregate condition of a key; null is no violation."""

    code: str
    bad: Column
    whole: bool = False


def violations(df: DataFrame, rules: list[Rule], key: str, step: str, exempt: str | None = None) -> DataFrame:
    """(key, step, code) of each violation; those of whole keys have no step.  One scan and one sort by key for all row rules, one aggregation for the others.

    exempt: a column that is true on all rows of keys that the rules do not hold for, as traces older than what they claim.
    """
    broken = lambda some: F.array_compact(F.array(*(F.when(F.coalesce(r.bad, F.lit(False)), F.lit(r.code)) for r in some)))
    if exempt:
        df = df.where(~F.coalesce(exempt, F.lit(False)))
    by_row, whole = [r for r in rules if not r.whole], [r for r in rules if r.whole]
    parts = []
    if by_row:
        parts.append(df.select(F.col(key).alias("key"), F.col(step).cast("long").alias("step"), broken(by_row).alias("codes")))
    if whole:
        parts.append(df.groupBy(F.col(key).alias("key")).agg(broken(whole).alias("codes")).select("key", F.lit(None).cast("long").alias("step"), "codes"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("key", "step", F.explode("codes").alias("code"))


def conversation_rules() -> list[Rule]:
    """A trace's rules on conversations: steps without gaps, roles in turn, no empty and no repeated text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return [
        Rule("turn_gap", F.col("turn") - F.lag("turn").over(w) != 1),
        Rule("system_not_first", (F.col("role") == "system") & (F.row_number().over(w) != 1)),
        Rule("role_repeated", F.lag("role").over(w) == F.col("role")),
        Rule("unknown_role", ~F.col("role").isin("system", "user", "assistant")),
        Rule("empty_text", F.coalesce(F.trim("text"), F.lit("")) == ""),
        Rule("repeated_text", F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn")) > 1),
        Rule("no_user_turn", F.count_if(F.col("role") == "user") == 0, whole=True),
        Rule("ends_with_user", F.max_by("role", "turn") == "user", whole=True),
    ]


def state_machine(df: DataFrame, key: str, order: str, event: str, moves: dict[str, tuple[str, ...]], start: tuple[str, ...]) -> DataFrame:
    """(key, order, from, to, allowed) of every step: which events may follow which is a table, looked up by the event before."""
    before = F.lag(event).over(Window.partitionBy(key).orderBy(order))
    table = F.create_map(*(x for k, v in moves.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    allowed = F.when(before.isNull(), F.col(event).isin(*start)).otherwise(F.coalesce(F.array_contains(F.try_element_at(table, before), F.col(event)), F.lit(False)))
    return df.select(key, order, before.alias("from_event"), F.col(event).alias("to_event"), allowed.alias("allowed"))


def ledger(df: DataFrame, key: str, order: str, kind: str, created: Column) -> DataFrame:
    """Running number of what each step has created, by kind: <kind>_<n> ids, and all ids so far."""
    w = Window.partitionBy(key, kind).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__made", created.cast("int")).withColumn("number", F.sum("__made").over(w).cast("long"))
    so_far = F.sum("__made").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return rows.select(key, order, kind, F.when(F.col("__made") == 1, F.concat_ws("_", F.col(kind), F.col("number").cast("string"))).alias("evidence_id"), "number", so_far.alias("available"))


def reasons(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules)))


#: Columns of an agent trace that every step must have.
TRACE_FIELDS = ("raw", "effective", "suffix", "status", "available")
HOST_TURN = r"(?im)^\s*(Tool result\b|HOST TURN\b)"


def trace_rules(key: str = "question_id", step: str = "step") -> list[Rule]:
    """Rules on agent traces.

    Columns: raw, effective and suffix texts; span_start, span_end of the action in raw (null: none); action (null: none parsed);
    status (ok, rejected, error); evidence_id that the step made; refs that it cites; available ids before it, in order.
    """
    w = Window.partitionBy(key).orderBy(step)
    raw, effective, suffix, end = F.col("raw"), F.col("effective"), F.col("suffix"), F.col("span_end")
    texts = raw.isNotNull() & effective.isNotNull() & suffix.isNotNull()
    spanned = F.col("span_start").isNotNull()
    good_span = (F.col("span_start") >= 0) & (F.col("span_start") < end) & (end <= F.length("raw"))
    rebuilt = F.when(spanned, (effective == F.trim(F.left("raw", end))) & (suffix == F.substring(raw, end + 1, F.length("raw")))).otherwise((effective == raw) & (suffix == ""))
    made = F.collect_list("evidence_id").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # the ids of each kind, each once: as many as the highest number
    ids = F.collect_set(F.when(F.col("evidence_id").isNotNull(), F.struct(F.regexp_extract("evidence_id", "^(.*)_[0-9]+$", 1).alias("p"), F.regexp_extract("evidence_id", "_([0-9]+)$", 1).cast("long").alias("n"))))
    alike = lambda e: F.filter(ids, lambda o: o["p"] == e["p"])
    gap = F.exists(ids, lambda e: F.array_max(F.transform(alike(e), lambda o: o["n"])) != F.size(alike(e)))
    missing = F.lit(False)
    for name in TRACE_FIELDS:
        missing = missing | F.col(name).isNull()
    return [
        Rule("missing_trace_fields", missing),
        Rule("invalid_boundary_text", ~texts),
        Rule("invalid_action_span", spanned & ~good_span),
        Rule("boundary_reconstruction_mismatch", texts & (~spanned | good_span) & ~rebuilt),
        Rule("missing_action_boundary", ~spanned & raw.contains('{"action"')),
        Rule("parsed_action_without_boundary", ~spanned & F.col("action").isNotNull()),
        Rule("multiple_effective_actions", F.regexp_count("effective", F.lit(r'\{"action"')) > 1),
        Rule("simulated_host_in_effective_history", effective.rlike(HOST_TURN)),
        Rule("accepted_unknown_evidence", (F.col("status") == "ok") & (F.size(F.array_except("refs", made)) > 0)),
        Rule("missing_call_id", (F.col("status") == "ok") & (F.col("action") == "query") & F.col("evidence_id").isNull()),
        Rule("duplicate_evidence_id", F.array_contains(made, F.col("evidence_id"))),  # by what was made before: a window of its own would sort the texts and lists
        Rule("rejection_created_evidence", (F.col("status") != "ok") & F.col("evidence_id").isNotNull()),
        Rule("ledger_registry_mismatch", F.col("available") != made),
        Rule("evidence_counter_gap", gap, whole=True),
    ]


#: What the ledger calls a step of each status, and what a grounding and a query must say of where they come from.
LEDGER_WORDS = {"ok": "accepted", "rejected": "rejected", "error": "failed"}
GROUNDING_FIELDS, QUERY_FIELDS = ("model", "clip", "frame"), ("grounding_id", "clip")


def call_rules(key: str = "question_id", step: str = "step") -> list[Rule]:
    """Rules on what the tools of a trace gave.

    Columns: span_text (the action's own text) and parsed (the action that was run), as JSON; status; kind (ground, query, math) of an accepted call;
    evidence_id that it made; ledger (JSON with last_action and new_id); cache_hit and reuse_of; result and registered (the result as
    kept elsewhere), provenance, as JSON; registered_clip (the clip that the registry keeps with the step's evidence, whatever the
    provenance in the trace says); first_action (text of the first action in the raw reply).
    """
    w = Window.partitionBy(key).orderBy(step)
    made = F.collect_list("evidence_id").over(w.rowsBetween(Window.unboundedPreceding, -1))
    span, parsed, ledger, source = (Record(F.col(c)) for c in ("span_text", "parsed", "ledger", "provenance"))
    name = lambda r: F.coalesce(r.at("$.action", "string"), r.at("$.name", "string"))
    plain = lambda c: F.to_json(F.try_parse_json(c))  # noqa: E731  one form, so that only contents differ
    ok, hit, cached = F.col("status") == "ok", F.col("cache_hit"), F.col("reuse_of").isNotNull()
    word = F.create_map(*(F.lit(x) for kv in LEDGER_WORDS.items() for x in kv))
    lacks = lambda r, fields: ~_all(r.filled(f"$.{f}") | r.is_number(f"$.{f}") for f in fields)
    cited = source.at("$.grounding_id", "string")
    clip = source.at("$.clip", "string")
    # the clip of the grounding that a query cites, by the registry
    clips = F.collect_list(F.when((F.col("kind") == "ground") & F.col("evidence_id").isNotNull(), F.struct(F.col("evidence_id").alias("id"), F.col("registered_clip").alias("clip")))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    known = F.get(F.filter(clips, lambda c: c["id"] == cited), F.lit(0))
    grounded, queried = ok & (F.col("kind") == "ground"), ok & (F.col("kind") == "query")
    return [
        Rule("action_span_decode_mismatch", F.col("span_text").isNotNull() & ~span.is_object()),
        Rule("first_action_boundary_mismatch", F.col("span_text").isNotNull() & (F.col("span_text") != F.col("first_action"))),
        Rule("parsed_action_mismatch", span.is_object() & ~name(span).eqNullSafe(name(parsed))),
        Rule("parsed_action_payload_mismatch", span.is_object() & name(span).eqNullSafe(name(parsed)) & ~F.to_json(span.at("$.arguments")).eqNullSafe(F.to_json(parsed.at("$.arguments")))),
        Rule("invalid_ledger", ~ledger.is_object() | ~ledger.is_string("$.last_action")),
        Rule("ledger_action_mismatch", ledger.is_string("$.last_action") & (ledger.string("$.last_action") != F.coalesce(F.try_element_at(word, F.col("status")), F.lit("")))),
        Rule("ledger_new_id_mismatch", ledger.is_object() & ~F.when(ledger.is_string("$.new_id"), ledger.string("$.new_id")).eqNullSafe(F.col("evidence_id"))),
        Rule("invalid_cache_hit", hit & ((F.col("kind") != "ground") | F.col("kind").isNull())),
        Rule("invalid_cache_reuse", F.coalesce(hit, F.lit(False)) != cached),
        Rule("reused_unknown_evidence", cached & (~F.array_contains(made, F.col("reuse_of")) | F.col("evidence_id").isNotNull())),
        Rule("trace_registry_result_mismatch", F.col("evidence_id").isNotNull() & ~plain(F.col("result")).eqNullSafe(plain(F.col("registered")))),
        Rule("invalid_grounding_provenance", grounded & lacks(source, GROUNDING_FIELDS)),
        Rule("invalid_query_provenance", queried & (lacks(source, QUERY_FIELDS) | (known.isNotNull() & (known["clip"] != clip)))),
        Rule("invalid_failure_provenance", (F.col("status") == "error") & (F.col("kind") == "ground") & ~source.filled("$.model")),
        Rule("cross_clip_registry", F.countDistinct(F.when(grounded, clip)) > 1, whole=True),
    ]


#: What a trace entry has since traces keep their effective history, and the kinds of evidence.
SINCE = ("effective_response", "evidence_state")
EVIDENCE = r"^(qg|d4rt|math)_[0-9]+$"


def attempts(records: DataFrame, key: str, payload: str) -> DataFrame:
    """key, trace (the entries' JSON texts; null: no list), registry (ids in order; null: no object), created (ids of accepted entries in order), legacy.

    An attempt is legacy if it has entries and none of them keeps an effective history.
    """
    at = lambda p: F.get_json_object(payload, p)
    trace = F.when(F.trim(at("$.trace")).startswith("["), F.from_json(at("$.trace"), "array<string>"))
    registry = F.when(F.trim(at("$.evidence")).startswith("{"), F.json_object_keys(at("$.evidence")))
    rows = records.select(F.col(key).cast("string").alias("key"), trace.alias("trace"), registry.alias("registry"))
    entries = F.filter(F.coalesce("trace", F.array().cast("array<string>")), is_entry)
    field = lambda x, f: F.get_json_object(x, f"$.{f}")
    made = F.filter(entries, lambda x: (field(x, "status") == "ok") & field(x, "call_id").rlike(EVIDENCE) & (F.coalesce(field(x, "cache_hit"), F.lit("false")) != "true"))
    keeps = F.exists(entries, lambda x: F.arrays_overlap(F.json_object_keys(x), F.array(*map(F.lit, SINCE))))
    return rows.withColumns({"created": F.transform(made, lambda x: field(x, "call_id")), "legacy": (F.size(F.coalesce("trace", F.array().cast("array<string>"))) > 0) & ~keeps})


def is_entry(x: Column) -> Column:
    return F.coalesce(F.trim(x).startswith("{"), F.lit(False))


def attempt_violations(records: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, step, code) of records: attempts without a trace or a registry, entries that are no objects, registries that differ from what the trace made; and that there are no records at all.

    payload: the attempt's JSON text.  The last entries' ids are judged only where the attempt is not legacy.
    """
    rows = attempts(records, key, payload)
    none = F.array().cast("array<string>")
    modern = ~F.col("legacy") & (F.size(F.filter(F.coalesce("trace", none), is_entry)) > 0)
    codes = reasons(("invalid_trace", F.col("trace").isNull()), ("invalid_registry", F.col("registry").isNull()), ("final_registry_mismatch", modern & (F.coalesce("registry", none) != F.col("created"))))
    whole = rows.select("key", F.lit(None).cast("long").alias("step"), F.explode(codes).alias("code"))
    entries = rows.select("key", F.posexplode("trace").alias("at", "entry")).where(~is_entry(F.col("entry")))
    entries = entries.select("key", (F.col("at") + 1).cast("long").alias("step"), F.lit("invalid_trace_row").alias("code"))
    empty = records.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("<directory>").alias("key"), F.lit(None).cast("long").alias("step"), F.lit("no_answer_records").alias("code"))
    return whole.unionByName(entries).unionByName(empty)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
