"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source s has a mean repetition rate: target share times the size of the mixture, over the rows it has.  A
row's uniform number comes from a seeded digest of its doc_id; the row's copy count is the inverse of the Poisson
distribution at that number.  The copies are dealt globally by a second digest.  Only one row for each source is
gathered for the rates.  It is broadcast where all sources together have at most BROADCAST_VALUES numbers, so that the
texts are shuffled once only; beyond that it is joined by source, and Spark splits the hot ones.

Defined results: a null source is a source of its own; a null doc_id counts as the text 'null'; repeated rows get
equal counts; a null or empty text is replicated like any other; no rows give no rows; further columns are carried
along, except ones named like the three this operator adds (copy, copies, shuffle_key), which are replaced; with
added=False nothing is added and all of them stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import cut

DIGITS = 13
BROADCAST_VALUES = 2_000_000


def unit(seed: str, *cols: Column) -> Column:
    """A number in (0, 1) from a digest of the seed and the columns; any SQL engine with md5 gives the same."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float = 1.0) -> DataFrame:
    """(source, rate, cdf): the mean copies of a row, and P(count <= k) for k = 0, 1, ... until it is 1 to 16 digits.

    weights: target weight of each source, 0 for others; None: the source's rows to the power of temperature.
    total: rows of the mixture as a multiple of the rows of docs.
    """
    size = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        size = size.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        given = [F.when(F.col("source") == F.lit(k), F.lit(float(v))) for k, v in weights.items()]
        size = size.withColumn("w", F.coalesce(*given, F.lit(0.0)))
    all_w, all_n = size.agg(F.sum("w")).scalar(), size.agg(F.sum("n")).scalar()
    rate = size.where(all_w > 0).select("source", (F.col("w") / all_w * all_n * F.lit(float(total)) / F.col("n")).alias("rate"))
    # Running sums of logs keep large rates from underflow; the tail beyond rate + 12 deviations + 40 is below 1e-30.
    step = rate.where("rate > 0").withColumn("k", F.explode(F.expr("sequence(0, cast(ceil(rate + 12 * sqrt(rate) + 40) as int))")))
    so_far = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    term = F.sum(F.when(F.col("k") > 0, F.log("rate") - F.log("k")).otherwise(-F.col("rate"))).over(so_far)
    steps = step.select("source", "rate", "k", term.alias("term")).withColumn("sum", F.sum(F.exp("term")).over(so_far))
    cdf = F.sort_array(F.collect_list(F.struct("k", F.least(F.col("sum"), F.lit(1.0)).alias("sum"))))
    return steps.groupBy("source", "rate").agg(cdf.getField("sum").alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float = 1.0, seed: str = "mix", deal: bool = True, added: bool = True) -> DataFrame:
    """docs with each row repeated by its Poisson count, dealt by shuffle_key: with copies, copy (from 1) and shuffle_key if added."""
    spark = docs.sparkSession
    base = docs.select(F.col("source"), F.col("doc_id"), unit(seed, F.col("doc_id")).alias("u"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rate = cut(rates(base, weights, temperature, total).select(F.col("source").alias("rate_source"), "cdf"), "mixture-rates")
    if (rate.agg(F.sum(F.size("cdf"))).first()[0] or 0) <= BROADCAST_VALUES:
        rate = F.broadcast(rate)
    drawn = base.join(rate, F.col("source").eqNullSafe(F.col("rate_source")))
    counted = drawn.select("row", "doc_id", F.size(F.filter("cdf", lambda c: c < F.col("u"))).alias("copies")).where("copies > 0")
    copied = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = copied.select("row", "copies", "copy", unit(seed + "-order", F.col("doc_id"), F.col("copy")).alias("shuffle_key"))
    if deal:  # the key is uniform, so its ranges are known without a sample, and the rows are drawn once
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartitionById(parts, F.least(F.floor(F.col("shuffle_key") * parts), F.lit(parts - 1)).cast("int")).sortWithinPartitions("shuffle_key")
    if not added:
        return out.select("row.*")
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("copies", "copy", "shuffle_key")]
    return out.select(*own, "copies", "copy", "shuffle_key")


def query(spark, sf_dir):
    from fieldloom.llm.common import table

    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


#: The query's rows in DuckDB.
ORACLE = """
WITH RECURSIVE size AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
rate AS (SELECT source, w / (SELECT sum(w) FROM size) * (SELECT sum(n) FROM size)::DOUBLE * 1.0 / n AS rate FROM size),
cdf AS (SELECT source, rate, 0 AS k, -rate AS term, exp(-rate) AS s FROM rate
  UNION ALL SELECT source, rate, k + 1, term + ln(rate) - ln(k + 1), s + exp(term + ln(rate) - ln(k + 1)) FROM cdf
  WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
drawn AS (SELECT d.*, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents d),
steps AS (SELECT source, list(least(s, 1.0) ORDER BY k) AS cdf FROM cdf GROUP BY source),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, len(list_filter(s.cdf, lambda c: c < d.u))::INTEGER AS copies
  FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, text, lang, source, n_chars, copies, copy::INTEGER AS copy,
  (('0x' || substr(md5('mix-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted WHERE copies > 0)
"""
