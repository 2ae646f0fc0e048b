"""Queries over labelled documents as answered questions: scoring, coverage, sampling, joins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import sampling, scoring
from ..session import table
from .registry import query

#: Truth is the quality label; two deterministic predictors read lengths and languages.
A = """with a as (select d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic, case when l.quality = 1 then 'A' else 'B' end as gt,
  case when d.n_chars % 11 = 0 then 'NO_ANSWER' when d.n_chars % 7 = 0 then 'UNMAPPABLE' when d.n_chars > 300 then 'A' else 'B' end as pred,
  case when d.n_chars % 5 = 0 then null when d.lang = 'en' then 'A' else 'B' end as pred2 from labels l join documents d using (doc_id))"""


def answers(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    n = F.col("n_chars")
    pred = F.when(n % 11 == 0, "NO_ANSWER").when(n % 7 == 0, "UNMAPPABLE").when(n > 300, "A").otherwise("B")
    return rows.select("doc_id", "source", "lang", "n_chars", "quality", "toxic", F.when(F.col("quality") == 1, "A").otherwise("B").alias("gt"), pred.alias("pred"), F.when(n % 5 == 0, None).when(F.col("lang") == "en", "A").otherwise("B").alias("pred2"))


@query(
    A
    + """ select coalesce(case when grouping(source) = 0 then 'source' end, case when grouping(lang) = 0 then 'lang' end, case when grouping(toxic) = 0 then 'toxic' end, 'all') as dimension,
  coalesce(case when grouping(source) = 0 then source end, case when grouping(lang) = 0 then lang end, case when grouping(toxic) = 0 then toxic::varchar end, 'all') as member,
  count(*) as n, count(*) filter (pred not in ('UNMAPPABLE', 'NO_ANSWER')) as mapped, count(*) filter (pred = 'UNMAPPABLE') as unmappable, count(*) filter (pred = 'NO_ANSWER') as no_answer, count(*) filter (pred = gt) as correct,
  round(count(*) filter (pred = gt) / count(*), 6) as acc_all, round(count(*) filter (pred = gt) / nullif(count(*) filter (pred not in ('UNMAPPABLE', 'NO_ANSWER')), 0), 6) as acc_mapped,
  round(count(*) filter (pred not in ('UNMAPPABLE', 'NO_ANSWER')) / count(*), 6) as map_rate from a group by grouping sets ((), (source), (lang), (toxic))"""
)
def score_cube(spark, sf_dir):
    return scoring.score_cube(answers(spark, sf_dir), "pred", "gt", "source", "lang", "toxic")


@query(A + " select count(*) as n, count(*) filter (pred in ('A','B')) as parsed, count(*) filter (pred <> 'NO_ANSWER') as completed, count(*) filter (pred = gt) as correct, round(count(*) filter (pred = gt) / count(*), 6) as acc_all, round(count(*) filter (pred = gt) / count(*) filter (pred in ('A','B')), 6) as acc_parsed, round(count(*) filter (pred = gt) / count(*) filter (pred <> 'NO_ANSWER'), 6) as acc_completed from a")
def accuracy_denominators(spark, sf_dir):
    return scoring.accuracy_denominators(answers(spark, sf_dir), F.col("pred") == F.col("gt"), F.col("pred").isin("A", "B"), F.col("pred") != "NO_ANSWER")


@query(
    A
    + """, f as (select 'first' as run, pred as before, pred2 as after, gt from a union all select 'longest', case when n_chars > 1000 then 'A' else 'B' end, pred2, gt from a)
  select run, case when before is not distinct from after then 'same' when after is not distinct from gt then 'gain' when before is not distinct from gt then 'loss' else 'changed_wrong' end as flip, count(*) as n from f group by 1, 2"""
)
def answer_flips(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn("longest", F.when(F.col("n_chars") > 1000, "A").otherwise("B"))
    return scoring.answer_flips(rows, {"first": "pred", "longest": "longest"}, "pred2", "gt")


@query(A + ", c as (select gt, pred, count(*) as n from a group by 1, 2) select gt, pred, n, round((select sum(n) from c where gt = pred) / (select sum(n) from c), 6) as agreement from c")
def confusion_matrix(spark, sf_dir):
    return scoring.confusion(answers(spark, sf_dir), "gt", "pred")


@query(A + " select count(*) as total, count(*) filter (pred = pred2) as agree, count(*) filter (pred = 'UNMAPPABLE' and pred2 is not null) as escalated, count(*) filter (pred in ('A','B') and pred2 is not null and pred <> pred2) as overrode from a")
def rule_agreement(spark, sf_dir):
    mapped, given = F.col("pred").isin("A", "B"), F.col("pred2").isNotNull()
    return answers(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("pred") == F.col("pred2")).alias("agree"), F.count_if((F.col("pred") == "UNMAPPABLE") & given).alias("escalated"), F.count_if(mapped & given & (F.col("pred") != F.col("pred2"))).alias("overrode"))


@query(A + ", s as (select lang, pred, count(*) as n from a group by 1, 2) select a.lang, count(*) filter (pred = gt) as correct, count(*) as total, round(count(*) filter (pred = gt) / count(*), 6) as accuracy, (select string_agg(pred || '=' || n, ';' order by pred) from s where s.lang = a.lang) as statuses from a group by a.lang")
def per_task_status_map(spark, sf_dir):
    rows = answers(spark, sf_dir)
    statuses = rows.groupBy("lang", "pred").agg(F.count("*").alias("n")).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("pred", "n"))).alias("m"))
    text = F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.element_at("m", k).cast("string"))), ";")
    right = F.count_if(F.col("pred") == F.col("gt"))
    return rows.groupBy("lang").agg(right.alias("correct"), F.count("*").alias("total"), scoring.share(right, F.count("*")).alias("accuracy")).join(statuses.select("lang", text.alias("statuses")), "lang")


@query(A + " select count(*) as n, count(*) filter (pred in ('A','B')) as answered, round(count(*) filter (pred = gt and n_chars > 500) / nullif(count(*) filter (n_chars > 500), 0), 6) as acc_measured, round(count(*) filter (pred = gt and n_chars <= 500) / nullif(count(*) filter (n_chars <= 500), 0), 6) as acc_unmeasured, round(avg(n_chars), 4) as mean_steps, max(n_chars) as max_steps, round(avg((toxic = 1)::int), 6) as retry_rate from a")
def run_summary(spark, sf_dir):
    long, right = F.col("n_chars") > 500, F.col("pred") == F.col("gt")
    return answers(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("pred").isin("A", "B")).alias("answered"), scoring.share(F.count_if(right & long), F.count_if(long)).alias("acc_measured"), scoring.share(F.count_if(right & ~long), F.count_if(~long)).alias("acc_unmeasured"), F.round(F.avg("n_chars"), 4).alias("mean_steps"), F.max("n_chars").alias("max_steps"), F.round(F.avg((F.col("toxic") == 1).cast("int")), 6).alias("retry_rate"))


@query("with d as (select distinct source from documents), f as (select source, count(*) as n from documents where n_chars > 5000 group by 1), z as (select source, coalesce(n, 0) as n from d left join f using (source)) select source, n, round(100 * n / sum(n) over (), 6) as share from z")
def zero_filled_frequency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "n_chars")
    return scoring.zero_filled(docs, docs.where("n_chars > 5000"), "source")


@query("with c as (select lang, source, count(*) as n from documents group by 1, 2) select lang, string_agg(source || ':' || n, ',' order by n desc, source) as cells from c group by 1")
def crosstab_list(spark, sf_dir):
    return scoring.crosstab(table(spark, sf_dir, "documents"), "lang", "source")


@query("with c as (select lang, source, count(*) as n from documents group by 1, 2), r as (select *, row_number() over (partition by lang order by n desc, source) as rank from c) select lang, source, n, rank from r where rank <= 3")
def top3_per_group(spark, sf_dir):
    return scoring.top_modes(table(spark, sf_dir, "documents"), "lang", "source")


@query(
    """with d as (select *, ascii(left(md5('7:' || doc_id), 1)) % 4 = 0 as drawn, n_chars > 800 as long from documents), p as (select lang, source, count(*) as pop from d group by 1, 2), n as (select lang, source, count(*) as drawn from d where drawn group by 1, 2),
  c as (select lang, source, long, count(*) as n from d where drawn group by 1, 2, 3) select long, round(sum(pop * c.n / n.drawn), 6) as estimate from c join n using (lang, source) join p using (lang, source) group by 1"""
)
def post_stratified_estimate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") > 800).alias("long"))
    drawn = docs.where(F.ascii(F.left(sampling.hash_order(7, "doc_id"), F.lit(1))) % 4 == 0)
    return scoring.post_stratified(docs, drawn, ["lang", "source"], "long")


@query("select doc_id, 'missing' as problem from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'extra' from labels where doc_id not in (select doc_id from documents)")
def coverage_diff(spark, sf_dir):
    return scoring.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("select d.doc_id, d.source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def pending_antijoin(spark, sf_dir):
    """What has no output yet."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select o_orderkey, o_orderstatus from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_discount > 0.08)")
def cited_semijoin(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").where("l_discount > 0.08").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(cited, "o_orderkey", "left_semi")


@query("with a as (select doc_id, case when toxic = 1 then 'A' else 'B' end as letter from labels) select r.i as row_index, coalesce(letter, 'E') as answer from (select unnest(range(0, (select max(doc_id) + 1 from documents))) as i) r left join a on a.doc_id = r.i")
def left_default_export(spark, sf_dir):
    """One answer per position; positions without one hold the sentinel."""
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0
    given = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_index"), F.when(F.col("toxic") == 1, "A").otherwise("B").alias("answer"))
    return spark.range(last + 1).withColumnRenamed("id", "row_index").join(given, "row_index", "left").select("row_index", F.coalesce("answer", F.lit("E")).alias("answer"))


@query("select c.c_mktsegment as segment, n.n_name as nation, r.r_name as region, count(*) as n, round(sum(o_totalprice), 2) as total from orders o join customer c on o_custkey = c_custkey join nation n on c_nationkey = n_nationkey join region r on n_regionkey = r_regionkey group by 1, 2, 3")
def lookup_joins(spark, sf_dir):
    """Facts with their chain of dimensions; which sides are sent whole is left to measured sizes."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("orders").select("o_custkey", "o_totalprice").join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(A + " select a.doc_id, a.gt, a.pred, b.pred2, (a.pred = a.gt)::int - coalesce((b.pred2 = a.gt)::int, 0) as lead from a join a b using (doc_id)")
def run_comparison(spark, sf_dir):
    rows = answers(spark, sf_dir)
    current, other = rows.select("doc_id", "gt", "pred"), rows.select("doc_id", "pred2")
    hit = lambda c: F.coalesce((F.col(c) == F.col("gt")).cast("int"), F.lit(0))
    return current.join(other, "doc_id").select("doc_id", "gt", "pred", "pred2", (hit("pred") - hit("pred2")).alias("lead"))


# ---- sampling ----


@query("with s as (select source, row_number() over (order by source) - 1 as i from (select distinct source from documents)) select source, i as row, (i + k) % 6 as cate from s, (select unnest(range(0, 5)) as k)")
def latin_cells(spark, sf_dir):
    """Five cells for each source, shifted by one from source to source."""
    rows = sampling.latin_cells(table(spark, sf_dir, "documents"), "source")
    return rows.select("source", F.col("row").cast("long").alias("row"), "cate")


@query("select doc_id from documents order by md5('11:' || doc_id), doc_id limit 50")
def hash_sample(spark, sf_dir):
    return sampling.uniform(table(spark, sf_dir, "documents").select("doc_id"), 50, 11, "doc_id")


@query("with f as (select *, row_number() over (partition by lang, source order by md5('3:' || doc_id), doc_id) as f from documents), r as (select *, row_number() over (partition by lang order by md5('3:' || doc_id), doc_id) as r from f where f = 1) select lang, source, doc_id from r where r <= 8")
def quota_stratified(spark, sf_dir):
    return sampling.quota(table(spark, sf_dir, "documents").select("lang", "source", "doc_id"), "lang", 8, 3, "doc_id", "source").select("lang", "source", "doc_id")


# Sequential draws: in SQL a recursion over the cells, each filters its list by the videos taken so far.
_QUOTAS = {"click": 12, "view": 12, "purchase": 30, "scroll": 12, "error": 12, "signup": 12}


@query(
    """with recursive q(cell, n, turn) as (values ('click', 12, 0), ('view', 12, 1), ('purchase', 30, 2), ('scroll', 12, 3), ('error', 12, 4), ('signup', 12, 5)),
  e as (select event_id, event_type, user_id, user_id % 2 as task, value > 150 as rare, md5('5:' || event_id) as h from events where event_type in (select cell from q)),
  k as (select e.*, n, turn, row_number() over (partition by task, event_type, rare order by h, event_id) as k from e join q on cell = event_type),
  p as (select *, case when not rare then 1 when k <= greatest(1, n // 5) then 0 else 2 end as place from k),
  b as (select task, turn, user_id, arg_min(event_id, (place, h)) as event_id, min({'p': place, 'h': h, 'e': event_id}) as o from p group by 1, 2, 3),
  l as (select task, turn, list({'u': user_id, 'e': event_id} order by o) as l from b group by 1, 2), g as (select distinct task from e),
  r as (select task, 0 as turn, []::struct(u bigint, e bigint)[] as got, []::bigint[] as used from g union all
    select task, turn + 1, got, used || list_transform(got, lambda x: x.u) from (select r.task, r.turn, r.used, list_slice(list_filter(coalesce(l.l, []), lambda x: not list_contains(r.used, x.u)), 1, q.n) as got from r join q on q.turn = r.turn left join l on l.task = r.task and l.turn = r.turn)),
  c as (select task, turn - 1 as turn, unnest(got).e as event_id from r where turn > 0),
  s as (select p.task, p.event_type, p.event_id, p.n - (select count(*) from c where c.task = p.task and c.turn = p.turn) as missing, row_number() over (partition by p.task, p.event_type order by p.place, p.h, p.event_id) as again from p where event_id not in (select event_id from c))
  select p.task, p.event_type, c.event_id, 0 as turn from c join p using (event_id) union all select task, event_type, event_id, 1 from s where again <= missing"""
)
def rare_first_stratified(spark, sf_dir):
    """Events of each type, rare ones first, for two tasks: users differ within a task as far as they suffice."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", (F.col("user_id") % 2).alias("task"))
    return sampling.rare_first(rows, "event_type", F.col("value") > 150, _QUOTAS, 5, "event_id", "user_id", "task").select("task", "event_type", "event_id", "turn")


@query(
    """with recursive a as (select source, least(count(*), 40) as n from documents group by 1),
  s as (select source, n, coalesce(sum(n) over (order by n, source rows between unbounded preceding and 1 preceding), 0) as before, count(*) over () - row_number() over (order by n, source) + 1 as open from a),
  l as (select *, (500 - before) // open as level from s), c as (select * from l where n > level order by n, source limit 1),
  q as (select source, n, coalesce(n <= level, true) as full_, row_number() over (partition by n <= level order by source) as rn from l)
  select source, case when full_ then n else (select level from c) + case when rn <= 500 - (select before from c) - (select level from c) * (select open from c) then 1 else 0 end end::bigint as quota from q"""
)
def water_fill(spark, sf_dir):
    available = table(spark, sf_dir, "documents").groupBy("source").agg(F.least(F.count("*"), F.lit(40)).alias("available"))
    return sampling.water_fill(available, "source", "available", 500)


@query(
    """with d as (select doc_id, lang from documents), s as (select unnest(range(0, 20)) as seed), r as (select seed, lang, row_number() over (partition by seed order by md5(seed || ':' || doc_id), doc_id) as r from d, s),
  c as (select seed, count(*) filter (lang = 'en') as a, count(*) filter (lang = 'fr') as b, count(*) filter (lang = 'de') as c from r where r <= 25 group by 1) select min(seed)::bigint as seed from c where a between 10 and 20 and b between 2 and 12 and c between 2 and 12"""
)
def balanced_seed(spark, sf_dir):
    return sampling.balanced_seed(table(spark, sf_dir, "documents"), "lang", "doc_id", 25, {"en": (10, 20), "fr": (2, 12), "de": (2, 12)})


@query("with h as (select lang, count(*) as n from documents group by 1) select lang, n, (select bool_and(n between 10 and 900) from h) as balanced from h")
def histogram_balance(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.withColumn("balanced", F.bool_and(F.col("n").between(10, 900)).over(Window.partitionBy()))


@query("with c as (select o_orderpriority, count(*) as n, count(distinct o_custkey) as customers from orders group by 1) select * from c")
def count_distinct_by_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("select user_id, event_type, count(*) as n from events group by 1, 2 having count(*) > 20")
def dup_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n > 20")


@query("with r as (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) - 1 as i from part) select p_brand, p_partkey, i % 4 as shard from r")
def shard_mod(spark, sf_dir):
    """Rows dealt in turn, brand by brand, so that no window spans the whole table."""
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.pmod(i, F.lit(4)).cast("long").alias("shard"))


@query("select source, count(distinct lang) as langs, count(distinct lang) = 1 as invariant, string_agg(distinct lang, ',' order by lang) as names from documents group by 1")
def identity_invariance(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source")
    return rows.agg(F.count_distinct("lang").alias("langs"), (F.count_distinct("lang") == 1).alias("invariant"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("names"))


@query("select lang, round(avg(n_chars) filter (quality = 0), 4) as low, round(avg(n_chars) filter (quality = 1), 4) as high from labels join documents using (doc_id) group by 1")
def policy_pivot(spark, sf_dir):
    rows = answers(spark, sf_dir).groupBy("lang").pivot("quality", [0, 1]).agg(F.round(F.avg("n_chars"), 4))
    return rows.select("lang", F.col("0").alias("low"), F.col("1").alias("high"))


@query("with r as (select lang, source, n_chars, dense_rank() over (partition by lang order by n_chars desc) as rank from documents where n_chars is not null) select lang, source, n_chars, rank from r where rank <= 3")
def dense_top3(spark, sf_dir):
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"))).cast("long")
    return table(spark, sf_dir, "documents").where("n_chars is not null").select("lang", "source", "n_chars", rank.alias("rank")).where("rank <= 3")


@query("with f as (select source, text, min(doc_id) as id from documents group by 1, 2), r as (select source, id, row_number() over (partition by source order by id) as rn from f) select source, id as doc_id, rn from r where rn <= 2")
def first_two_examples(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").groupBy("source", F.sha2("text", 256).alias("t")).agg(F.min("doc_id").alias("doc_id"))
    return texts.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long")).where("rn <= 2").select("source", "doc_id", "rn")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def most_expensive(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("select c_mktsegment, count(*) as n from customer where c_acctbal > 0 and c_mktsegment in ('BUILDING', 'AUTOMOBILE') group by 1")
def selection_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").where((F.col("c_acctbal") > 0) & F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("select count(*) as n, count(*) filter (upper(trim(lang)) <> lang) as repaired from documents")
def answer_normalisations(spark, sf_dir):
    """Reads one column; how many values case and white space change."""
    return table(spark, sf_dir, "documents").select("lang").agg(F.count("*").alias("n"), F.count_if(F.upper(F.trim("lang")) != F.col("lang")).alias("repaired"))
