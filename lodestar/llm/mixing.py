"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.runtime import task_count

#: A table of rates up to this many rows goes to every task; a larger one is joined by salted keys.
BROADCAST_SOURCES = 200_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, the same for the same parts on every engine: the head of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(N <= k) for k = 0, 1, ... up to where no double below 1 is left above it."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    first = F.struct((-mean).alias("lp"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        lp = acc["lp"] + F.log(mean) - F.log(k.cast("double"))
        c = acc["c"] + F.exp(lp)
        return F.struct(lp.alias("lp"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), last), first, step, lambda acc: acc["all"])).otherwise(F.array(F.lit(1.0)))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float | None = None) -> DataFrame:
    """``source, rate``: the mean number of copies of a document of each source.

    Target weights are the given ones (sources left out get 0) or, without,
    proportional to the number of documents to the power ``temperature``.
    ``total`` is the expected number of documents drawn; as many as there are,
    if not given.  A null source is a source of its own (weights: key ``None``).
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        w = F.pow("n", F.lit(float(temperature)))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(w)
    weighted = sizes.select("source", "n", w.alias("w"))
    sums = weighted.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))  # one row
    goal = F.col("all_n") if total is None else F.lit(float(total))
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * goal / F.col("n")).otherwise(0.0)
    return weighted.join(F.broadcast(sums)).select("source", rate.alias("rate"))


def mix(docs: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """Each document as often as its hash-seeded Poisson number says, globally shuffled.

    Adds ``rate``, ``copy`` (from 1) and ``shuffle_key`` (partitions and rows
    ascend by it); columns of these names in ``docs`` are replaced.  The same
    seed, id and rate give the same number.  A null id counts as the MD5 of its
    text; repeated rows get equal numbers and so stay repeated; a source
    without a rate, or of rate 0, is left out.  The key follows the text, too,
    so that texts of one id are spread.
    """
    table = rates.select(F.col("source").alias("__source"), F.col("rate"), poisson_cdf(F.col("rate")).alias("__cdf"))
    rows = docs.drop("rate", "copy", "shuffle_key")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(table), rows["source"].eqNullSafe(F.col("__source")))
    else:
        salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__own", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__salt"))).drop("__own", "__salt")
    identity = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    drawn = joined.withColumn("__u", uniform(F.lit(str(seed)), identity))
    # inverse distribution function: the number of k with P(N <= k) <= u
    number = F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))
    copies = drawn.withColumn("copy", F.explode(F.when(number > 0, F.sequence(F.lit(1), number)).otherwise(F.array().cast("array<int>")))).drop("__cdf", "__u", "__source")
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), identity, F.col("copy"), text)))
    n = task_count(docs)
    # keys are uniform, so equal ranges of their heads hold equal shares: no sampling pass
    part = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * n).cast("int")
    return keyed.withColumn("__part", part).repartitionById(n, "__part").drop("__part").sortWithinPartitions("shuffle_key")
