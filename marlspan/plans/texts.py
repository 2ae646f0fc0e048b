"""Queries over texts and records: options, letters, templates, families, keys, JSON, arithmetic, audits."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as num
from ..functions import text as tx
from ..operators import actions, audit, windows
from ..session import table
from .registry import query

_PAIRS = "select r_regionkey, 'A: ' || r_name || '; B: ' || coalesce(min(n_name), '-') || ' ; C: ' || coalesce(max(n_name), '-') || ';' as s, list(n_name order by n_nationkey) as l from region left join nation on n_regionkey = r_regionkey group by r_regionkey, r_name"


def options(spark: SparkSession, sf_dir: str):
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.min("n_name").alias("a"), F.max("n_name").alias("b"), F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))["n_name"].alias("l"))
    rows = table(spark, sf_dir, "region").join(nations, "r_regionkey", "left")
    return rows.select("r_regionkey", F.concat(F.lit("A: "), F.col("r_name"), F.lit("; B: "), F.coalesce("a", F.lit("-")), F.lit(" ; C: "), F.coalesce("b", F.lit("-")), F.lit(";")).alias("s"), "l")


@query(f"with o as ({_PAIRS}), p as (select r_regionkey, unnest(list_filter(list_transform(string_split(s, ';'), lambda x: trim(x)), lambda x: x <> '')) as p from o) select r_regionkey, string_agg(regexp_extract(p, '^([A-Z])\\s*[:.]\\s*(.+)$', 1) || '=' || trim(regexp_extract(p, '^([A-Z])\\s*[:.]\\s*(.+)$', 2)), ';' order by p) as options from p group by 1")
def option_map_string(spark, sf_dir):
    return options(spark, sf_dir).select("r_regionkey", tx.map_text(tx.option_map("s")).alias("options"))


@query(
    r"""with recursive p as (select p_partkey, [case p_partkey % 4 when 0 then 'A. ' || p_name when 1 then p_name when 2 then ' z) ' || p_name else 'b: ' || p_name || chr(10) || p_type || ' ' end,
    case when p_partkey % 3 = 0 then 'B. ' || p_brand when p_partkey % 3 = 1 then 'a) ' || p_brand else p_brand end, case when p_partkey % 5 < 2 then 'C: ' || p_type else 'm ' || p_type end] as l from part),
  f as (select p_partkey, l, 0 as i, map([]::varchar[], []::varchar[]) as m from p union all
    select p_partkey, l, i + 1, case when named and not list_contains(map_keys(m), letter) then map_concat(m, map([letter], [body])) else map_concat(m, map([chr(65 + i)], [trim(t)])) end from
      (select *, upper(regexp_extract(t, '(?s)^\s*([A-Za-z])\s*[.):]', 1)) as letter, regexp_matches(t, '(?s)^\s*[A-Za-z]\s*[.):]') as named, trim(regexp_replace(t, '(?s)^\s*[A-Za-z]\s*[.):]\s*', '')) as body from (select *, l[i + 1] as t from f where i < 3)))
  select p_partkey, array_to_string(list_transform(list_sort(map_keys(m)), lambda k: k || '=' || m[k]), ';') as options from f where i = 3"""
)
def option_map_list(spark, sf_dir):
    """Options with letters of any case, out of order, taken twice, over several lines, and without one."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    first = F.when(key % 4 == 0, F.concat(F.lit("A. "), "p_name")).when(key % 4 == 1, F.col("p_name")).when(key % 4 == 2, F.concat(F.lit(" z) "), "p_name")).otherwise(F.concat(F.lit("b: "), "p_name", F.lit("\n"), "p_type", F.lit(" ")))
    second = F.when(key % 3 == 0, F.concat(F.lit("B. "), "p_brand")).when(key % 3 == 1, F.concat(F.lit("a) "), "p_brand")).otherwise(F.col("p_brand"))
    third = F.when(key % 5 < 2, F.concat(F.lit("C: "), "p_type")).otherwise(F.concat(F.lit("m "), "p_type"))
    return part.select("p_partkey", F.array(first, second, third).alias("l")).select("p_partkey", tx.map_text(tx.option_list_map("l")).alias("options"))


_REPLIES = """with r as (select conv_id, turn, case turn % 7 when 0 then text || ' <answer> b </answer>' when 1 then 'I think the answer is C. ' || text when 2 then text || chr(10) || '**A**' when 3 then '<D because ' || text
  when 4 then 'B) it is ' || text when 5 then '<Q> ' || text || ' answer: c' else 'none ' || text end as reply from conversations)"""
#: The patterns in SQL's own words: its engine has no lookahead, and what follows a letter is then a character of its own.
_NAMED = (
    "<answer>\\s*([A-Za-z])\\s*</answer>", "<\\s*([A-Za-z])(?:[^A-Za-z]|$)", "^\\**\\s*([A-Za-z])\\s*[.):,]", "^\\**\\s*([A-Za-z])\\**\\s*$", "\\banswer\\s*(?:is)?\\s*[:-]?\\s*([A-Za-z])\\b",
)
_LETTER = "coalesce(" + ", ".join(f"case when upper(regexp_extract(trim(reply), '(?im){p}', 1)) in ('A','B','C','D') then upper(regexp_extract(trim(reply), '(?im){p}', 1)) end" for p in _NAMED) + ")"


def replies(spark: SparkSession, sf_dir: str):
    kind, text = F.col("turn") % 7, F.col("text")
    made = F.when(kind == 0, F.concat(text, F.lit(" <answer> b </answer>"))).when(kind == 1, F.concat(F.lit("I think the answer is C. "), text)).when(kind == 2, F.concat(text, F.lit("\n**A**")))
    made = made.when(kind == 3, F.concat(F.lit("<D because "), text)).when(kind == 4, F.concat(F.lit("B) it is "), text)).when(kind == 5, F.concat(F.lit("<Q> "), text, F.lit(" answer: c")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", made.otherwise(F.concat(F.lit("none "), text)).alias("reply"))


@query(_REPLIES + f" select conv_id, turn, {_LETTER} as letter from r")
def choice_letter(spark, sf_dir):
    return replies(spark, sf_dir).select("conv_id", "turn", tx.choice_letter("reply").alias("letter"))


@query(_REPLIES + f" select conv_id, turn, coalesce({_LETTER}, nullif(regexp_extract(reply, '\\b([A-D])\\b', 1), '')) as letter from r")
def letter_fallback(spark, sf_dir):
    return replies(spark, sf_dir).select("conv_id", "turn", tx.letter_or_token("reply").alias("letter"))


@query(_REPLIES + " select conv_id, turn, nullif(upper(regexp_extract(reply, '(?i)<answer>\\s*([A-D])\\s*</answer>', 1)), '') as letter from r")
def strict_letter(spark, sf_dir):
    return replies(spark, sf_dir).select("conv_id", "turn", tx.strict_letter("reply").alias("letter"))


_Q = "with q as (select p_partkey, 'How far does the ' || p_name || '''s camera move in ' || p_size || '.5 m at ' || p_type || ', and which way is the dog facing?' as question, case p_partkey % 4 when 0 then p_size || ' m / s' when 1 then p_size || ' meters' else p_name end as options, p_partkey % 3 as kind, p_name from part), s as (select p_partkey, options, case kind when 0 then question when 1 then 'What best describes the composition of ' || p_name else 'How many ' || p_name || ' appear larger?' end as question from q)"


def questions(spark: SparkSession, sf_dir: str):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    size = F.col("p_size").cast("string")
    first = F.concat(F.lit("How far does the "), "p_name", F.lit("'s camera move in "), size, F.lit(".5 m at "), "p_type", F.lit(", and which way is the dog facing?"))
    kind = F.col("p_partkey") % 3
    question = F.when(kind == 0, first).when(kind == 1, F.concat(F.lit("What best describes the composition of "), "p_name")).otherwise(F.concat(F.lit("How many "), "p_name", F.lit(" appear larger?")))
    by = F.col("p_partkey") % 4
    return part.select("p_partkey", F.when(by == 0, F.concat(size, F.lit(" m / s"))).when(by == 1, F.concat(size, F.lit(" meters"))).otherwise(F.col("p_name")).alias("options"), question.alias("question"))


_TEMPLATE = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(question, '(?i)\\bthe\\s+[a-z][a-z ''_-]{0,30}?''s\\b', 'the SUBJ''s', 'g'), '\\d+(\\.\\d+)?', 'N', 'g'), '[^A-Za-z'' ]', ' ', 'g'), ' +', ' ', 'g')))"


@query(_Q + f" select {_TEMPLATE} as template, count(*) as n from s group by 1")
def template_scan(spark, sf_dir):
    return questions(spark, sf_dir).groupBy(tx.template("question").alias("template")).agg(F.count("*").alias("n"))


@query(_Q + f", t as (select {_TEMPLATE} as template, p_partkey % 3 as task, count(*) as n from s group by 1, 2), k as (select template, sum(n) as n, string_agg(task || ':' || n, ',' order by task) as by_task from t group by 1) select template, n::bigint as n, by_task from k order by n desc, template limit 25")
def template_topk(spark, sf_dir):
    counts = questions(spark, sf_dir).groupBy(tx.template("question").alias("template"), (F.col("p_partkey") % 3).alias("task")).agg(F.count("*").alias("n"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("task", "n"))), lambda s: F.concat_ws(":", s["task"].cast("string"), s["n"].cast("string")))
    return counts.groupBy("template").agg(F.sum("n").alias("n"), F.array_join(parts, ",").alias("by_task")).orderBy(F.desc("n"), "template").limit(25)


@query(_Q + f" select p_partkey, regexp_replace(regexp_replace(question, '\\bthe\\s+[a-zA-Z][a-zA-Z ''_-]*?''s\\b', 'the SUBJ''s', 'g'), '(?i)\\b({'|'.join(tx.SUBJECT_NOUNS)})\\b', 'SUBJ', 'g') as template from s")
def noun_template(spark, sf_dir):
    return questions(spark, sf_dir).select("p_partkey", tx.noun_template("question").alias("template"))


_MATCH = [(f.name, f"regexp_matches({f.on}, '(?i){f.pattern}')") for f in tx.FAMILIES]


@query(_Q + " select p_partkey, case " + " ".join(f"when {c} then '{n}'" for n, c in _MATCH) + " else 'unfamilied' end as family from s")
def family_primary(spark, sf_dir):
    return questions(spark, sf_dir).select("p_partkey", tx.family("question", "options").alias("family"))


@query(_Q + ", f as (select array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in _MATCH) + "], lambda x: x is not null), '+') as families from s) select families, count(*) as n from f where families like '%+%' group by 1 order by n desc, families limit 20")
def family_overlap(spark, sf_dir):
    rows = questions(spark, sf_dir).select(tx.all_families("question", "options").alias("f")).where(F.size("f") > 1)
    return rows.groupBy(F.array_join("f", "+").alias("families")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "families").limit(20)


@query("with s as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(lower(url), '\\.[^.]*$', ''), '[\\s/]+', '_', 'g'), '[^a-z0-9._-]', '', 'g') as stem from pages) select page_id, regexp_replace(right(regexp_replace(stem, '^_+|_+$', '', 'g'), 60), '^_+|_+$', '', 'g') || '_' || left(sha1(url), 8) as slug from s")
def path_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.slug("url").alias("slug"))


@query("select page_id, left(sha256(page_id || '|' || url), 12) as probe_id, left(sha256(url), 16) as url_key from pages")
def composite_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.composite_id("page_id", "url").alias("probe_id"), tx.composite_id("url", length=16).alias("url_key"))


@query("with s as (select doc_id, case doc_id % 5 when 0 then null when 1 then '' when 2 then '  ' || left(text, 50) || ' ' else left(text, 40) end as s from documents), l as (select *, lower(trim(s, ' ' || chr(9) || chr(10) || chr(13))) as t from s) select doc_id, case when s is null or s = '' then 'camera_only' else trim(left(regexp_replace(t, '[^\\p{L}\\p{N}]', '_', 'g'), 32), '_') || '_' || left(sha1(t), 10) end as subject_key from l")
def subject_key(spark, sf_dir):
    by, text = F.col("doc_id") % 5, F.col("text")
    s = F.when(by == 0, F.lit(None).cast("string")).when(by == 1, "").when(by == 2, F.concat(F.lit("  "), F.left(text, F.lit(50)), F.lit(" "))).otherwise(F.left(text, F.lit(40)))
    return table(spark, sf_dir, "documents").select("doc_id", tx.subject_key(s).alias("subject_key"))


@query("select doc_id, replace(lower(trim(regexp_replace(nfc_normalize(text), '[\\s\\x0B]+', ' ', 'g'))), 'ß', 'ss') as name_key from documents")
def name_key(spark, sf_dir):
    """The key of every whole text; in SQL the texts' only letter that case folding takes further than lower case is written out."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.normal_key("text").alias("name_key"))


@query("select doc_id, left(text, 40) as head, regexp_replace(regexp_extract(text, '^[^.;:]*', 0), '\\s+', ' ', 'g') as clause, regexp_replace(lower(left(text, 30)), '[^a-z0-9]+', '-', 'g') as anchor, case when lang in ('en', 'fr') then lang else 'OTHER' end as label, regexp_replace(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(.{1,96})(?: |$)|(.{96})', '\\1\\2' || chr(10), 'g'), '\\n$', '') as wrapped from documents")
def presentation_strings(spark, sf_dir):
    """Strings of every document."""
    rows = table(spark, sf_dir, "documents")
    clause = F.regexp_replace(F.regexp_extract("text", "^[^.;:]*", 0), r"\s+", " ")
    return rows.select("doc_id", F.left("text", F.lit(40)).alias("head"), clause.alias("clause"), F.regexp_replace(F.lower(F.left("text", F.lit(30))), "[^a-z0-9]+", "-").alias("anchor"), tx.clamp("lang", ("en", "fr")).alias("label"), tx.wrapped("text", 96).alias("wrapped"))


# ---- JSON ----


@query("select event_id, (props->>'k')::bigint as k, abs((props->>'k')::double - value) <= greatest(1e-3, 1e-3 * abs(value)) as matches from events")
def json_path_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.parse_json("props").alias("p"))
    k = F.try_variant_get("p", "$.k", "bigint")
    return rows.select("event_id", k.alias("k"), (F.abs(k.cast("double") - F.col("value")) <= F.greatest(F.lit(1e-3), 1e-3 * F.abs("value"))).alias("matches"))


@query("with g as (select user_id, list((props->>'k')::double) as ks, max(value) as v from events group by 1) select user_id, len(ks) as n, len(list_filter(ks, lambda c: abs(v - c) <= greatest(1e-3, 1e-3 * abs(v)))) > 0 as supported from g")
def value_match_tolerance(spark, sf_dir):
    """Whether a reported value is among a user's calculated ones, within the tolerance."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.get_json_object("props", "$.k").cast("double")).alias("ks"), F.max("value").alias("v"))
    near = F.exists("ks", lambda c: F.abs(F.col("v") - c) <= F.greatest(F.lit(1e-3), 1e-3 * F.abs("v")))
    return rows.select("user_id", F.size("ks").cast("long").alias("n"), near.alias("supported"))


@query("select event_id, [(props->>'k')::double, 1.5] as numbers from events")
def numeric_scalars(spark, sf_dir):
    """The numbers of every event."""
    nested = F.concat(F.lit('{"a": '), "props", F.lit(', "b": [true, {"c": 1.5}]}'))
    return table(spark, sf_dir, "events").select("event_id", actions.finite_numbers(nested).alias("numbers"))


_ACT = "'think {x} ' || event_type || ' {\"action\": \"' || event_type || '\", \"n\": ' || (event_id % 7) || '} tail' || case when event_id % 3 = 0 then ' {\"name\": \"again\"}' else '' end"


def action_texts(spark: SparkSession, sf_dir: str):
    text = F.concat(F.lit("think {x} "), "event_type", F.lit(' {"action": "'), "event_type", F.lit('", "n": '), (F.col("event_id") % 7).cast("string"), F.lit("} tail"), F.when(F.col("event_id") % 3 == 0, ' {"name": "again"}').otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", text.alias("t"))


@query(f"with a as (select event_id, {_ACT} as t from events), m as (select event_id, t, regexp_extract(t, '\\{{\"action\"[^}}]*\\}}', 0) as v from a) select event_id, v as action, position(v in t)::integer - 1 as start_at, position(v in t)::integer - 1 + length(v)::integer as end_at from m")
def first_action_span(spark, sf_dir):
    rows = action_texts(spark, sf_dir).select("event_id", actions.first_action("t").alias("a"))
    return rows.select("event_id", F.col("a.value").alias("action"), F.col("a.start").alias("start_at"), F.col("a.end").alias("end_at"))


@query("select event_id, case when event_id % 3 = 0 then 2 else 1 end::bigint as n from events")
def action_count(spark, sf_dir):
    return action_texts(spark, sf_dir).select("event_id", F.size(actions.actions("t")).cast("long").alias("n"))


@query("select event_id, case when event_id % 2 = 0 then '[1, ' || (event_id % 7) || ']' end as box from events")
def strict_field_json(spark, sf_dir):
    number = (F.col("event_id") % 7).cast("string")
    text = F.concat(F.lit('say {"bbox": [1, '), number, F.lit("], "), F.lit('"x": 1} '), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"bbox": [1, '), number, F.lit("]}"))).otherwise("{}"))
    return table(spark, sf_dir, "events").select("event_id", actions.strict_field(text, "bbox").alias("box"))


@query("select event_id, event_type, value > 50 as visible from events")
def nested_field_drop(spark, sf_dir):
    """Host-only fields dropped from a struct and from the structs of an array."""
    rows = table(spark, sf_dir, "events").select("event_id", F.struct("event_type", F.lit("secret").alias("host"), F.array(F.struct((F.col("value") > 50).alias("visible"), F.lit(1).alias("host"))).alias("preds")).alias("r"))
    rows = rows.withColumn("r", F.col("r").dropFields("host").withField("preds", F.transform("r.preds", lambda p: p.dropFields("host"))))
    return rows.select("event_id", F.col("r.event_type").alias("event_type"), F.get("r.preds", F.lit(0))["visible"].alias("visible"))


# ---- numbers ----


@query("select i as k, round_even(i * (n - 1) / 31.0, 0)::bigint as idx, n from (select unnest(range(0, 32)) as i), (select count(*) as n from documents)")
def uniform_index_sample(spark, sf_dir):
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return n.select("n", F.posexplode(num.uniform_indices("n", 32)).alias("k", "idx")).select(F.col("k").cast("long").alias("k"), "idx", "n")


@query("select i, j, round(0.05 * 640 + i * 0.9 * 640 / 11, 6) as u, round(0.05 * 480 + j * 0.9 * 480 / 11, 6) as v from (select unnest(range(0, 12)) as i), (select unnest(range(0, 12)) as j)")
def grid_points(spark, sf_dir):
    """A 12 x 12 grid over the middle nine tenths of a picture: a fixed number of points."""
    i = spark.range(12).withColumnRenamed("id", "i")
    rows = i.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("j", F.col("j").cast("long"))
    return rows.select("i", "j", F.round(0.05 * 640 + F.col("i") * 0.9 * 640 / 11, 6).alias("u"), F.round(0.05 * 480 + F.col("j") * 0.9 * 480 / 11, 6).alias("v"))


PROGRAM = "d = [a, b, a + b]\nm = mean(d)\ns = std(d)\nn = norm(d)\nr = round(hypot(a, b), 2)\nq = a % 7 + max(d) ** 0.5 - d[1] / 2"


@query("with x as (select l_orderkey, l_linenumber, l_quantity as a, l_tax as b from lineitem) select l_orderkey, l_linenumber, round((2*a+2*b)/3, 6) as m, round(sqrt(((a-(2*a+2*b)/3)^2+(b-(2*a+2*b)/3)^2+(a+b-(2*a+2*b)/3)^2)/3), 6) as s, round(sqrt(a*a+b*b+(a+b)^2), 6) as n, round(((a % 7) + 7) % 7 + sqrt(greatest(a, b, a + b)) - b / 2, 6) as q from x")
def calculator_eval(spark, sf_dir):
    """A calculator program compiled to columns, on every line item."""
    rows = table(spark, sf_dir, "lineitem")
    out = actions.compile_program(PROGRAM, {"a": F.col("l_quantity"), "b": F.col("l_tax")})
    return rows.select("l_orderkey", "l_linenumber", *(F.round(out[k], 6).alias(k) for k in ("m", "s", "n", "q")))


@query("select vec_id, round(1/(1+exp(-embedding[7]::double)), 6) as visibility, round(least(greatest(embedding[9]::double * 640 / 1000, 0), 640), 6) as u from embeddings")
def unit_conversions(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return rows.select("vec_id", F.round(num.sigmoid(at(6)), 6).alias("visibility"), F.round(num.pixels(at(8), 640), 6).alias("u"))


@query("select event_id, floor(epoch(ts))::bigint as seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, floor(epoch(ts))::bigint - floor(epoch(first_value(ts) over (partition by user_id order by ts, event_id)))::bigint as elapsed from events")
def elapsed_times(spark, sf_dir):
    first = F.first("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", seconds.alias("seconds"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), (seconds - F.unix_timestamp(first.cast("timestamp"))).alias("elapsed"))


# ---- audits ----


@query(
    """with w as (select *, lag(turn) over o as pt, lag(role) over o as pr, row_number() over o as rn, row_number() over (partition by conv_id, text order by turn) as again from conversations window o as (partition by conv_id order by turn)),
  v as (select conv_id, turn, 'turn_gap' as code from w where turn - pt <> 1 union all select conv_id, turn, 'system_not_first' from w where role = 'system' and rn <> 1 union all select conv_id, turn, 'role_repeated' from w where pr = role
   union all select conv_id, turn, 'unknown_role' from w where role not in ('system','user','assistant') union all select conv_id, turn, 'empty_text' from w where coalesce(trim(text), '') = '' union all select conv_id, turn, 'repeated_text' from w where again > 1
   union all select conv_id, null, 'no_user_turn' from w group by conv_id having count(*) filter (role = 'user') = 0 union all select conv_id, null, 'ends_with_user' from w group by conv_id having arg_max(role, turn) = 'user')
  select conv_id as key, turn as step, code from v"""
)
def trace_audit(spark, sf_dir):
    return audit.violations(table(spark, sf_dir, "conversations"), audit.conversation_rules(), "conv_id", "turn")


@query("with f as (select conv_id, turn, lag(role) over (partition by conv_id order by turn) as p, role from conversations) select conv_id, turn, p as from_event, role as to_event, case when p is null then role in ('system', 'user') when p in ('system', 'assistant') then role = 'user' when p = 'user' then role = 'assistant' else false end as allowed from f")
def state_machine_check(spark, sf_dir):
    moves = {"system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    return audit.state_machine(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", moves, ("system", "user"))


@query("with m as (select conv_id, turn, role, (length(text) % 2 = 0)::int as made from conversations), n as (select *, sum(made) over (partition by conv_id, role order by turn) as number, sum(made) over (partition by conv_id order by turn) as available from m) select conv_id, turn, role, case when made = 1 then role || '_' || number end as evidence_id, number::bigint as number, available::bigint as available from n")
def ledger_counters(spark, sf_dir):
    return audit.ledger(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", F.length("text") % 2 == 0)


@query("with r as (select doc_id, lang, list_filter([case when quality = 0 then 'hypothesis_differs' end, case when toxic = 1 then 'other_label' end, case when n_chars > 5000 then 'level_mismatch' end], lambda x: x is not null) as rs from labels join documents using (doc_id)) select lang, doc_id, array_to_string(rs, ';') as reasons from r where len(rs) > 0 order by lang, doc_id")
def review_queue(spark, sf_dir):
    """What a person should look at, sorted as it is read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    found = audit.reasons(("hypothesis_differs", F.col("quality") == 0), ("other_label", F.col("toxic") == 1), ("level_mismatch", F.col("n_chars") > 5000))
    return rows.select("lang", "doc_id", found.alias("r")).where(F.size("r") > 0).select("lang", "doc_id", F.array_join("r", ";").alias("reasons")).orderBy("lang", "doc_id")


@query("with r as (select doc_id, quality, toxic, unnest(list_filter([case when quality = 0 then 'hypothesis' end, case when toxic = 1 then 'other' end], lambda x: x is not null)) as reason from labels) select reason, count(*) as n from r group by 1")
def reason_histogram(spark, sf_dir):
    found = audit.reasons(("hypothesis", F.col("quality") == 0), ("other", F.col("toxic") == 1))
    return table(spark, sf_dir, "labels").select(F.explode(found).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("with r as (select p_partkey, list_filter([case when p_size < 3 then 'too_few_options' end, case when p_retailprice > 1900 then 'answer_not_offered' end, case when p_name = '' then 'empty_question' end], lambda x: x is not null) as issues from part) select p_partkey, unnest(issues) as issue from r")
def row_integrity(spark, sf_dir):
    found = audit.reasons(("too_few_options", F.col("p_size") < 3), ("answer_not_offered", F.col("p_retailprice") > 1900), ("empty_question", F.col("p_name") == ""))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("issue"))


@query("with f as (select l_orderkey, list(l_linenumber order by l_linenumber) as t from lineitem group by 1) select l_orderkey, len(t) as n, len(t) >= 2 and list_sort(list_distinct(t)) = range(t[1], t[len(t)] + 1) as contiguous from f")
def interval_completeness(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("t"))
    whole = F.size(F.array_except(F.sequence(F.array_min("t"), F.array_max("t")), F.col("t"))) == 0
    return rows.select("l_orderkey", F.size("t").cast("long").alias("n"), ((F.size("t") >= 2) & whole).alias("contiguous"))


@query("with o as (select p_partkey, p_brand, [p_name, p_type, p_brand] as opts, p_partkey % 3 as ans from part), l as (select *, length(opts[1]) as a, length(opts[2]) as b, length(opts[3]) as c from o), m as (select *, case when a >= b and a >= c then 0 when b >= c then 1 else 2 end as longest from l) select coalesce(p_brand, 'all') as brand, count(*) as n, round(100 * avg((longest = ans)::int), 6) as answer_longest, round(100 * avg((ans = 0)::int), 6) as answer_a from m group by grouping sets ((p_brand), ())")
def longest_option_shortcut(spark, sf_dir):
    """How often the answer is the longest option (the first of equals), or the first; by brand and in all."""
    rows = table(spark, sf_dir, "part").select("p_brand", F.array("p_name", "p_type", "p_brand").alias("opts"), (F.col("p_partkey") % 3).alias("ans"))
    longest = -F.array_max(F.transform("opts", lambda o, i: F.struct(F.length(o).alias("l"), (-i).alias("i"))))["i"]
    rows = rows.withColumn("hit", (longest == F.col("ans")).cast("int")).withColumn("first", (F.col("ans") == 0).cast("int"))
    out = rows.rollup("p_brand").agg(F.count("*").alias("n"), F.round(100 * F.avg("hit"), 6).alias("answer_longest"), F.round(100 * F.avg("first"), 6).alias("answer_a"))
    return out.select(F.coalesce("p_brand", F.lit("all")).alias("brand"), "n", "answer_longest", "answer_a")


@query("with o as (select p_brand, unnest([p_name, p_type]) as o from part) select p_brand, round(median(length(o)), 1) as median_length from o group by 1")
def option_length_median(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.explode(F.array("p_name", "p_type")).alias("o"))
    return rows.groupBy("p_brand").agg(F.round(F.median(F.length("o")), 1).alias("median_length"))


@query("select conv_id, count(*) as steps, count(*) filter (role = 'assistant') as accepted, count(*) filter (role = 'system') as rejected, round(avg(length(text)), 4) as mean_length, max(turn) as last_step from conversations group by 1")
def trace_counters(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("steps"), F.count_if(F.col("role") == "assistant").alias("accepted"), F.count_if(F.col("role") == "system").alias("rejected"), F.round(F.avg(F.length("text")), 4).alias("mean_length"), F.max("turn").alias("last_step"))


_TRACES = """with e as (select user_id as question_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as step from events),
  q as (select *, case when event_type = 'click' then 'query' else event_type end as act, case when event_id % 13 = 0 then 'rejected' else 'ok' end as status, sum((event_type = 'click')::int) over (partition by question_id order by step) as k from e),
  t as (select question_id, step, event_id, 'think {"action": "' || act || '"}' || case event_id % 17 when 0 then ' {"action": "x"}' when 1 then chr(10) || 'Tool result: y' else '' end as raw, case when event_id % 19 > 0 then 6 end as s0,
    case when event_id % 19 > 0 then 6 + length('{"action": "' || act || '"}') + case event_id % 17 when 0 then 16 when 1 then 15 else 0 end - case when event_id % 23 = 0 then 2 else 0 end end as s1, case when event_id % 29 > 0 then act end as action, status,
    case when event_type = 'click' and event_id % 31 > 0 then 'query_' || (k + case when event_id % 37 = 0 then 5 when event_id % 41 = 0 then -1 else 0 end) end as evidence_id,
    case when event_id % 43 = 0 then ['query_999'] when event_type = 'view' and k > 0 then ['query_1'] else [] end as refs from q),
  a as (select *, coalesce(list(evidence_id) filter (evidence_id is not null) over (partition by question_id order by step rows between unbounded preceding and 1 preceding), []) as made,
    case when event_id % 47 = 0 then null when s0 is null then raw else trim(left(raw, s1)) end as effective, case when s0 is null then '' else substr(raw, s1 + 1) || case when event_id % 53 = 0 then 'z' else '' end end as suffix from t),
  b as (select *, case when event_id % 59 = 0 then ['query_0'] else made end as available from a)"""


@query(
    _TRACES
    + """, v as (select question_id, step, 'missing_trace_fields' as code from b where effective is null union all select question_id, step, 'invalid_boundary_text' from b where effective is null
   union all select question_id, step, 'boundary_reconstruction_mismatch' from b where effective is not null and case when s0 is null then not (effective = raw and suffix = '') else not (effective = trim(left(raw, s1)) and suffix = substr(raw, s1 + 1)) end
   union all select question_id, step, 'missing_action_boundary' from b where s0 is null union all select question_id, step, 'parsed_action_without_boundary' from b where s0 is null and action is not null
   union all select question_id, step, 'multiple_effective_actions' from b where len(regexp_extract_all(effective, '\\{"action"')) > 1
   union all select question_id, step, 'simulated_host_in_effective_history' from b where regexp_matches(effective, '(?im)^\\s*(Tool result\\b|HOST TURN\\b)')
   union all select distinct question_id, step, 'accepted_unknown_evidence' from (select question_id, step, made, unnest(refs) as ref from b where status = 'ok') where not list_contains(made, ref)
   union all select question_id, step, 'missing_call_id' from b where status = 'ok' and action = 'query' and evidence_id is null
   union all select question_id, step, 'duplicate_evidence_id' from (select *, row_number() over (partition by question_id, evidence_id order by step) as rn from b where evidence_id is not null) where rn > 1
   union all select question_id, step, 'rejection_created_evidence' from b where status <> 'ok' and evidence_id is not null
   union all select question_id, step, 'ledger_registry_mismatch' from b where available <> made
   union all select question_id, null, 'evidence_counter_gap' from (select question_id, max(n) as most, count(*) as n from (select distinct question_id, regexp_extract(evidence_id, '_([0-9]+)$', 1)::bigint as n from b where evidence_id is not null) group by 1) where most <> n)
  select code, count(*) as n, count(distinct question_id) as questions from v group by 1"""
)
def agent_trace_audit(spark, sf_dir):
    """Violations by rule over agent traces made from events, with faults of every kind in them."""
    w = Window.partitionBy("question_id").orderBy("step")
    e = F.col("event_id")
    rows = windows.spread(table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), "event_id", "ts", "event_type"), "question_id")
    rows = rows.withColumn("step", (F.row_number().over(Window.partitionBy("question_id").orderBy("ts", "event_id")) - 1).cast("long"))
    click = F.col("event_type") == "click"
    rows = rows.withColumn("k", F.sum(click.cast("int")).over(w)).withColumn("act", F.when(click, "query").otherwise(F.col("event_type")))
    call = F.concat(F.lit('{"action": "'), "act", F.lit('"}'))
    tail = F.when(e % 17 == 0, ' {"action": "x"}').when(e % 17 == 1, "\nTool result: y").otherwise("")
    spanned = e % 19 > 0
    rows = rows.withColumns({
        "raw": F.concat(F.lit("think "), call, tail), "span_start": F.when(spanned, 6), "span_end": F.when(spanned, 6 + F.length(call) + F.length(tail) - F.when(e % 23 == 0, 2).otherwise(0)),
        "action": F.when(e % 29 > 0, F.col("act")), "status": F.when(e % 13 == 0, "rejected").otherwise("ok"),
        "evidence_id": F.when(click & (e % 31 > 0), F.concat(F.lit("query_"), (F.col("k") + F.when(e % 37 == 0, 5).when(e % 41 == 0, -1).otherwise(0)).cast("string"))),
        "refs": F.when(e % 43 == 0, F.array(F.lit("query_999"))).when((F.col("event_type") == "view") & (F.col("k") > 0), F.array(F.lit("query_1"))).otherwise(F.array().cast("array<string>")),
    })
    made = F.collect_list("evidence_id").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({
        "effective": F.when(e % 47 == 0, None).when(~spanned, F.col("raw")).otherwise(F.trim(F.left("raw", F.col("span_end")))),
        "suffix": F.when(~spanned, "").otherwise(F.concat(F.substring("raw", F.col("span_end") + 1, F.length("raw")), F.when(e % 53 == 0, "z").otherwise(""))),
        "available": F.when(e % 59 == 0, F.array(F.lit("query_0"))).otherwise(made),
    })
    found = audit.violations(rows, audit.trace_rules(), "question_id", "step")
    return found.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("key").alias("questions"))


_CALLS = """with e as (select user_id as question_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as step from events),
  b as (select *, case event_type when 'click' then 'ground' when 'view' then 'query' else 'math' end as kind, case when event_id % 11 = 0 then 'error' when event_id % 13 = 0 then 'rejected' else 'ok' end as status, sum((event_type = 'click')::int) over (partition by question_id order by step) as k from e),
  c as (select *, '{"action": "' || kind || '", "arguments": {"n": ' || step || '}}' as act, case when status = 'ok' and kind = 'ground' and event_id % 17 > 0 then 'g_' || k when status = 'ok' and kind <> 'ground' then kind || '_' || step end as evidence_id from b),
  d as (select *, coalesce(list(evidence_id) filter (evidence_id is not null) over (partition by question_id order by step rows between unbounded preceding and 1 preceding), []) as made,
    coalesce(list({'id': evidence_id, 'clip': 'c' || (question_id % 7)::varchar || case when event_id % 401 = 0 then 'x' else '' end}) filter (kind = 'ground' and evidence_id is not null) over (partition by question_id order by step rows between unbounded preceding and 1 preceding), []) as clips from c)"""


@query(
    _CALLS
    + """, v as (select question_id, 'action_span_decode_mismatch' as code from d where event_id % 19 = 0 union all select question_id, 'first_action_boundary_mismatch' from d where event_id % 19 = 0 or event_id % 23 = 0 or (event_id % 29 = 0 and event_id % 23 > 0 and event_id % 19 > 0)
   union all select question_id, 'parsed_action_mismatch' from d where event_id % 19 > 0 and event_id % 31 = 0 union all select question_id, 'parsed_action_payload_mismatch' from d where event_id % 19 > 0 and event_id % 31 > 0 and event_id % 37 = 0
   union all select question_id, 'invalid_ledger' from d where event_id % 41 = 0 union all select question_id, 'ledger_action_mismatch' from d where event_id % 41 > 0 and event_id % 43 = 0 union all select question_id, 'ledger_new_id_mismatch' from d where event_id % 41 > 0 and event_id % 47 = 0 and evidence_id is distinct from 'other_1'
   union all select question_id, 'invalid_cache_hit' from d where event_id % 17 = 0 and kind <> 'ground' union all select question_id, 'invalid_cache_reuse' from d where event_id % 17 = 0 and event_id % 5 = 0
   union all select question_id, 'reused_unknown_evidence' from d where event_id % 17 = 0 and event_id % 5 > 0 and (not list_contains(made, 'g_1') or evidence_id is not null)
   union all select question_id, 'trace_registry_result_mismatch' from d where evidence_id is not null and event_id % 53 = 0 union all select question_id, 'invalid_grounding_provenance' from d where status = 'ok' and kind = 'ground' and event_id % 59 = 0
   union all select question_id, 'invalid_query_provenance' from d where status = 'ok' and kind = 'query' and (event_id % 59 = 0 or coalesce(list_filter(clips, lambda x: x.id = 'g_1')[1].clip <> 'c' || (question_id % 7)::varchar || case when event_id % 401 = 0 then 'x' else '' end, false))
   union all select question_id, 'invalid_failure_provenance' from d where status = 'error' and kind = 'ground' and (event_id % 61 = 0 or event_id % 59 = 0)
   union all select question_id, 'cross_clip_registry' from (select question_id, count(distinct event_id % 401 = 0) as n from d where status = 'ok' and kind = 'ground' and event_id % 59 > 0 group by 1) where n > 1)
  select code, count(*) as n, count(distinct question_id) as questions from v group by 1"""
)
def tool_trace_audit(spark, sf_dir):
    """Violations by rule over what tools gave, with faults of every kind planted by the number of the event."""
    w = Window.partitionBy("question_id").orderBy("step")
    e = F.col("event_id")
    rows = windows.spread(table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), "event_id", "ts", "event_type"), "question_id")
    rows = rows.withColumn("step", (F.row_number().over(Window.partitionBy("question_id").orderBy("ts", "event_id")) - 1).cast("long"))
    kind = F.when(F.col("event_type") == "click", "ground").when(F.col("event_type") == "view", "query").otherwise("math")
    rows = rows.withColumns({"kind": kind, "status": F.when(e % 11 == 0, "error").when(e % 13 == 0, "rejected").otherwise("ok"), "k": F.sum((F.col("event_type") == "click").cast("int")).over(w)})
    own = F.when((F.col("kind") == "ground") & (e % 17 > 0), F.concat(F.lit("g_"), F.col("k").cast("string"))).when(F.col("kind") != "ground", F.concat_ws("_", F.col("kind"), F.col("step").cast("string")))
    act = lambda name, n: F.concat(F.lit('{"action": "'), name, F.lit('", "arguments": {"n": '), n.cast("string"), F.lit("}}"))
    right = act(F.col("kind"), F.col("step"))
    broken = e % 19 == 0
    clip = F.concat(F.lit("c"), (F.col("question_id") % 7).cast("string"), F.when(e % 401 == 0, "x").otherwise(""))
    status = F.create_map(*(F.lit(x) for kv in audit.LEDGER_WORDS.items() for x in kv))
    rows = rows.withColumns({"evidence_id": F.when(F.col("status") == "ok", own), "cache_hit": e % 17 == 0, "reuse_of": F.when((e % 17 == 0) & (e % 5 > 0), "g_1")})
    rows = rows.withColumns({
        "span_text": F.when(broken, "{ not json").otherwise(right), "first_action": F.when(broken | (e % 23 == 0) | (e % 29 == 0), F.lit("{}")).otherwise(right),
        "parsed": F.when(e % 31 == 0, act(F.lit("other"), F.col("step"))).when(e % 37 == 0, act(F.col("kind"), F.col("step") + 1)).otherwise(F.concat(F.lit('{ "arguments": {"n": '), F.col("step").cast("string"), F.lit('}, "action": "'), F.col("kind"), F.lit('"}'))),
        "ledger": F.when(e % 41 == 0, "[]").otherwise(F.to_json(F.struct(F.when(e % 43 == 0, "lost").otherwise(F.element_at(status, F.col("status"))).alias("last_action"), F.when(e % 47 == 0, "other_1").otherwise(F.col("evidence_id")).alias("new_id")))),
        "result": F.concat(F.lit('{"a": 1, "b": '), F.col("step").cast("string"), F.lit("}")), "registered": F.concat(F.lit('{"b": '), (F.col("step") + F.when(e % 53 == 0, 1).otherwise(0)).cast("string"), F.lit(', "a": 1}')),
        "provenance": F.to_json(F.struct(F.when((e % 59 > 0) & ((e % 61 > 0) | (F.col("status") != "error")), "m").alias("model"), F.when(e % 59 > 0, clip).alias("clip"), F.lit(3).alias("frame"), F.when(F.col("kind") == "query", "g_1").alias("grounding_id"))),
        "registered_clip": clip,
    })
    found = audit.violations(rows, audit.call_rules(), "question_id", "step")
    return found.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("key").alias("questions"))


@query(
    """with e as (select user_id as u, event_id, event_id % 97 = 0 as broken, event_type = 'click' and event_id % 3 > 0 and event_id % 97 > 0 as made from events), g as (select u, count(*) filter (made) as n, count(*) filter (broken) as broken, count(*) as entries from e group by 1),
  v as (select u, 'invalid_trace' as code, 1 as n from g where u % 11 = 0 union all select u, 'invalid_registry', 1 from g where u % 13 = 0 union all select u, 'invalid_trace_row', broken from g where u % 11 > 0 and broken > 0
    union all select u, 'final_registry_mismatch', 1 from g where u % 11 > 0 and u % 5 > 0 and entries > broken and n > 0 and (u % 13 = 0 or u % 7 = 0))
  select code, sum(n)::bigint as n, count(distinct u) as attempts from v group by 1"""
)
def attempt_audit(spark, sf_dir):
    """Violations of whole attempts, each a JSON record with its trace and its registry, made of a user's events; some are older than the history that others keep."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    made = (F.col("event_type") == "click") & (e % 3 > 0)
    entry = F.struct(F.when(e % 3 > 0, "ok").otherwise("rejected").alias("status"), F.when(made, F.concat(F.lit("qg_"), e.cast("string"))).otherwise("note").alias("call_id"), F.when(u % 5 > 0, "said").alias("effective_response"))
    rows = rows.select("user_id", e, F.when(e % 97 == 0, F.lit("7")).otherwise(F.to_json(entry)).alias("entry"), F.when(made & (e % 97 > 0), F.concat(F.lit('"qg_'), e.cast("string"), F.lit('": {}'))).alias("id"))
    parts = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "entry", "id"))).alias("l"))
    ids = F.array_compact(F.transform("l", lambda x: x["id"]))
    ids = F.when((u % 7 == 0) & (F.size(ids) > 0), F.slice(ids, F.lit(1), F.size(ids) - 1)).otherwise(ids)
    trace = F.when(u % 11 == 0, '"none"').otherwise(F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["entry"]), ", "), F.lit("]")))
    registry = F.when(u % 13 == 0, "[]").otherwise(F.concat(F.lit("{"), F.array_join(ids, ", "), F.lit("}")))
    records = parts.select("user_id", F.concat(F.lit('{"evidence": '), registry, F.lit(', "trace": '), trace, F.lit("}")).alias("payload"))
    found = audit.attempt_violations(records, "user_id", "payload")
    return found.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("key").alias("attempts"))
