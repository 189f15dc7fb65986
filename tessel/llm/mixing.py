"""Mixing sources to target weights by Poisson replication.

Each source has a target number of rows, so a mean number of repetitions of its documents. A
document's number of copies inverts the Poisson distribution of that mean at a uniform number
hashed from the seed and the document's id; copies then go in an order hashed from seed, id and
copy, which is a global shuffle. A source's share of all rows comes out at its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.scratch import free, save

SEED = "mix-1"
#: A source's weight is its number of documents to this power: below 1, small sources are repeated.
EXPONENT = 0.7
#: Rows out for each row in, in the mean.
EXPANSION = 1.0
#: Up to so many sources, about 10 MB, their rates are broadcast.
MAX_BROADCAST_SOURCES = 10_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts; null counts as an empty part."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = EXPONENT, expansion: float = EXPANSION) -> DataFrame:
    """source, rate: the mean number of copies of its documents. weights: relative target share by
    source, null as ""; a source that it leaves out gets none. None: by exponent. One row per
    source."""
    n = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    weight = F.pow(F.col("n").cast("double"), exponent)
    if weights is not None:
        weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
    n = n.withColumn("weight", weight)
    all_ = n.agg(F.sum("weight").alias("all_weights"), F.sum("n").alias("all_rows"))
    # one row on the right
    return n.crossJoin(all_).select("source", F.coalesce(F.col("weight") * expansion * F.col("all_rows") / F.nullif(F.col("all_weights") * F.col("n"), F.lit(0.0)), F.lit(0.0)).alias("rate"))


def cumulative(rate: Column) -> Column:
    """P(copies <= k) for k from 0 to so far beyond the mean that 52 bits don't tell the rest."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("sums"))
    return F.when(rate > 0, F.aggregate(
        F.sequence(F.lit(1), last), start,
        lambda s, k: F.struct(
            (s["log_p"] + F.ln(rate) - F.ln(k.cast("double"))).alias("log_p"),
            (s["sum"] + F.exp(s["log_p"] + F.ln(rate) - F.ln(k.cast("double")))).alias("sum"),
            F.concat(s["sums"], F.array(s["sum"] + F.exp(s["log_p"] + F.ln(rate) - F.ln(k.cast("double"))))).alias("sums"),
        ),
        lambda s: s["sums"],
    )).otherwise(F.array(F.lit(1.0)))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = EXPONENT, expansion: float = EXPANSION, seed: str = SEED) -> DataFrame:
    """The rows of docs as many times as drawn, with all their columns and two more after them: _copy
    (from 1) and _place, by which they are globally ordered; where docs has a column of such a name,
    it gets underscores more. Null sources are one source, null ids one id; equal rows draw alike.
    Texts, null or of any length, are only carried along. Rows whose draw is 0 have no copy."""
    source, sums, n, copy, place = (free(docs.columns, c) for c in ("_source", "_sums", "_n", "_copy", "_place"))
    table = rates(docs, weights, exponent, expansion).select(F.col("source").alias(source), cumulative(F.col("rate")).alias(sums))
    table = save(table, "rates")
    # few sources go to every task; more than that meet the rows in a join that splits hot ones
    table = F.broadcast(table) if table.count() <= MAX_BROADCAST_SOURCES else table
    u = uniform(F.lit(seed), docs["doc_id"])
    drawn = docs.join(table, F.coalesce(docs["source"], F.lit("")) == table[source]).withColumn(n, F.size(F.filter(table[sums], lambda c: c <= u))).drop(source, sums)
    each = drawn.filter(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)
    placed = each.withColumn(place, uniform(F.lit(seed + "-order"), each["doc_id"], each[copy]))
    return placed.orderBy(place, "doc_id", copy)


def op5_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each as often as drawn, in their new order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return replicate(docs).withColumnsRenamed({"_copy": "copy", "_place": "place"})


def _uniform_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT / {float(1 << 52)!r})"


ORACLE_SQL = f"""
WITH n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT s, pow(n::DOUBLE, {EXPONENT}) * {EXPANSION} * sum(n) OVER () / (sum(pow(n::DOUBLE, {EXPONENT})) OVER () * n) AS rate FROM n),
p AS (SELECT s, k, sum(exp(-rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) - lgamma(k + 1) END)) OVER (PARTITION BY s ORDER BY k) AS c
      FROM r, range(0, 400) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 24)),
d AS (SELECT doc_id, text, lang, source, n_chars, {_uniform_sql(f"'{SEED}'", "coalesce(doc_id::VARCHAR, '')")} AS u FROM documents),
x AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM p WHERE p.s = coalesce(d.source, '') AND p.c <= d.u) AS copies FROM d)
SELECT doc_id, text, lang, source, n_chars, k::INTEGER AS copy,
       {_uniform_sql(f"'{SEED}-order'", "coalesce(doc_id::VARCHAR, '')", "k::VARCHAR")} AS place
FROM x, range(1, 400) t(k) WHERE k <= copies
"""
