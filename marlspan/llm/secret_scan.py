"""Secret scans in DataFrame functions alone.

Named patterns find assignments, access keys and long hexadecimal runs.  Other runs of key
characters are judged by two character Markov models, one of random strings and one
of ordinary identifiers, trained as bigram counts from labelled samples: a run is a secret
if its log-likelihood ratio, in all and per character, is high enough.

The matches of a pattern and what lies between them (the same pattern, split) give
the positions.  The ratio table has a cell for each pair of ASCII characters and is a
literal of the plan; its size does not depend on the data.

Defined results.  Null is the empty text and has no spans.  Spans count code points, the end
exclusive; texts are scanned whole, however long.  An added span never overlaps a base span.
Repeated rows give equal rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's patterns (Java syntax), least lengths and what they measure, in the order of its kinds.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

#: Words of ordinary identifiers.
WORDS = (
    "get set find make read write open close load save item user name data file path list index count value total order price"
    " customer account message request response server client session config default option handler manager factory"
    " service controller repository component connection transaction authentication international environment information"
    " management development application description organization responsibility understanding communication government"
    " the and that with this from have there which their would about people other these right between through another"
    " schaft lich keit heit ung ver ein ge der die das und nicht mit sich auf fur zur bei nach ausgabe arbeit gesellschaft"
    " tion ment eau que les des une dans pour avec sur par plus comme tout nous vous elle etre avoir faire"
    " cion mente ado que los las una para con por esta como pero sus entre cuando muy sin sobre tambien"
).split()


@dataclass(frozen=True)
class Params:
    """samples: labelled strings of each class; least: characters of a run that is judged; ratio thresholds in nats."""

    samples: int = 6000
    least: int = 20
    total: float = 12.0
    per_char: float = 0.6


def labelled_samples(spark: SparkSession, n: int) -> DataFrame:
    """(label, s): label 1 random strings in several alphabets, label 0 identifiers and compound words."""
    ids = spark.range(n).withColumn("h", F.sha2(F.col("id").cast("string"), 256)).withColumn("b", F.base64(F.unhex("h")))
    alnum = F.regexp_replace("b", "[+/=]", "")
    random = F.element_at(F.array(F.col("h"), alnum, F.upper(F.regexp_replace("b", "[^A-Za-z0-9]", "")), F.translate("b", "+/=", "-_"), F.lower(alnum)), (F.col("id") % 5 + 1).cast("int"))
    words = F.array(*map(F.lit, WORDS))
    pick = lambda k: F.element_at(words, (F.conv(F.substring("h", 1 + 6 * k, 6), 16, 10).cast("long") % len(WORDS) + 1).cast("int"))
    parts = [pick(k) for k in range(6)]
    number = F.substring("h", 61, 1 + 0)
    styles = F.array(
        F.concat(parts[0], *map(F.initcap, parts[1:4])), F.concat_ws("_", *parts[:5]), F.concat_ws("-", *parts[:5]), F.concat_ws("/", *parts[:6]),
        F.concat(*parts), F.concat(*map(F.initcap, parts[:4])), F.upper(F.concat_ws("_", *parts[:4])), F.concat(F.concat_ws("_", *parts[:4]), F.regexp_replace(number, "[a-f]", "1")),
    )
    ordinary = F.element_at(styles, (F.col("id") % 8 + 1).cast("int"))
    return ids.select(F.lit(1).alias("label"), random.alias("s")).unionByName(ids.select(F.lit(0).alias("label"), ordinary.alias("s")))


def ratio_table(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) at 128 * a + b; at most 2 * 128 * 128 counts are fetched."""
    pairs = samples.select("label", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i"), "s")
    codes = pairs.select("label", F.ascii(F.substring("s", F.col("i"), F.lit(1))).alias("a"), F.ascii(F.substring("s", F.col("i") + 1, F.lit(1))).alias("b"))
    counts = {(r.label, r.a, r.b): r["n"] for r in codes.where("a between 0 and 127 and b between 0 and 127").groupBy("label", "a", "b").agg(F.count("*").alias("n")).collect()}
    totals: dict[tuple[int, int], int] = {}
    for (label, a, _), n in counts.items():
        totals[label, a] = totals.get((label, a), 0) + n

    def log_p(label: int, a: int, b: int) -> float:
        return math.log((counts.get((label, a, b), 0) + smoothing) / (totals.get((label, a), 0) + 67 * smoothing))

    return [log_p(1, a, b) - log_p(0, a, b) for a in range(128) for b in range(128)]


def log_ratio(s: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of an ASCII string: random against ordinary."""
    cells = F.array(*map(F.lit, table)) if len(table) < 64 else F.from_json(F.lit("[" + ",".join(f"{x:.4f}" for x in table) + "]"), "array<double>")
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))
    n = F.length(s) - 1
    steps = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.get(cells, a * 128 + b))
    return F.when(n > 0, F.aggregate(steps, F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0)))).otherwise(0.0)


def _spans(text: Column, pattern: str, quick: str, kind: str, good) -> Column:
    """array<struct<start, rank, end, kind, s>> of the pattern's matches that are good; texts without the quick pattern are passed over."""
    rank = KINDS.index(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,rank:int,end:int,kind:string,s:string>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("s"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(good(x["m"]), F.array(one)).otherwise(none)).alias("out"))

    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return F.when(text.rlike(quick), F.aggregate(zipped, state, step, lambda acc: acc["out"])).otherwise(none)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """Counts, base digest, spans and the ratios of the added spans of each document."""
    p = params or Params()
    table = ratio_table(labelled_samples(docs.sparkSession, p.samples))
    text = F.col("text")
    run = f"[A-Za-z0-9+/_=-]{{{p.least},}}"
    key = "(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = out.select(
        "doc_id",
        _spans(text, ASSIGN, key, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8).alias("assign"),
        _spans(text, ACCESS, "AKIA[A-Z0-9]{12}", "access", lambda m: F.length(m) >= 16).alias("access"),
        _spans(text, "[0-9a-f]{32,}", "[0-9a-f]{32}", "hex", lambda m: F.lit(True)).alias("hex"),
        # a lower-case word alone cannot be told from prose by its length: a digit, capital or sign must be there
        _spans(text, run, f"{run}", "random", lambda m: m.rlike("[0-9+/_=-]|[a-z][A-Z]") & m.rlike("[A-Za-z]") & (log_ratio(m, table) >= F.greatest(F.lit(p.total), F.length(m) * p.per_char))).alias("found"),
    )
    out = out.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    added = F.filter("found", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = out.withColumn("added", added)
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.transform("added", lambda s: log_ratio(s["s"], table)).alias("ratios"),
    )
