"""Problem 4: a sample that follows target category proportions, by systematic unequal-probability sampling.

Every id of a target's category has the same inclusion probability: the target's share of the sample over the ids that hold
the category, one at most. Within the sorted categories ids stand in random order (an md5 rank), probabilities are summed
along the whole order and from one random start every crossing of an integer draws an id, so each category gets its share
rounded down or up. Sums are kept in integers of 1/100 of a row. Then floors are repaired: a category drawn below its need
takes the next ids in the same order, as far as it has any. Nothing is taken back from other categories, so the sample is
larger than n by the ids that ``repaired`` counts.

Scale: the order is split by the first two hex digits of the rank, so a category with a third of all rows is 256 groups;
offsets come from a table of targets x 256 counts. Nothing is collected; targets are a small table that Spark broadcasts by
its measured size. The places are written once, to the shared folder, and read by the later steps.

Defined results: null categories are categories of their own; null ids are left out; repeated rows count once; an id with
several categories counts as available in each and is drawn for the first of its targets; a negative or null share or
minimum counts as 0; an empty table has sample size 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import keep

CATEGORIES = ("source_label", "headline_action", "multi_pipe")
FRACTION, SEED, START = 10, "4", 37


def _same(a: DataFrame, b: DataFrame, names: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in names))


def quotas(rows: DataFrame, targets: DataFrame, key: str = "hesum_id", categories: tuple[str, ...] = CATEGORIES, fraction: int = FRACTION) -> DataFrame:
    """(target_id, categories, pct, need, available, n): what each target asks for and how many ids hold its category."""
    rows = rows.select(F.col(key).alias("_id"), *categories).where("_id IS NOT NULL")
    # ids first become distinct within (id, categories), so a hot category is counted over all its ids' partitions
    held = rows.distinct().groupBy(*categories).agg(F.count("*").alias("available"))
    size = rows.select("_id").distinct().agg(F.floor(F.count("*") / fraction).cast("bigint").alias("n"))
    pct = F.greatest(F.coalesce("target_pct", F.lit(0)), F.lit(0)).cast("bigint")
    least = F.greatest(F.coalesce("min_rows", F.lit(0)), F.lit(0)).cast("bigint")
    t = targets.select("target_id", *categories, pct.alias("pct"), least.alias("least"))
    return (
        t.join(held, _same(t, held, categories), "left")
        .select("target_id", *(t[c] for c in categories), "pct", "least", F.coalesce("available", F.lit(0)).cast("bigint").alias("available"))
        .crossJoin(F.broadcast(size))  # one row
        .withColumn("need", F.greatest("least", F.floor(F.col("pct") * F.col("n") / 100)))
    )


def _ranked(rows: DataFrame, quota: DataFrame, key: str, categories: tuple[str, ...], seed: str) -> DataFrame:
    """Ids with their target and their place (from 1) in the target's random order."""
    rows = rows.select(F.col(key).alias("_id"), *categories).where("_id IS NOT NULL").distinct()
    mine = rows.join(quota, _same(rows, quota, categories)).groupBy("_id").agg(F.min("target_id").alias("target_id"))
    mine = mine.withColumn("_r", F.md5(F.concat(F.lit(seed + ":"), "_id"))).withColumn("_b", F.substring("_r", 1, 2))
    counts = mine.groupBy("target_id", "_b").agg(F.count("*").alias("_c"))
    offsets = counts.select("target_id", "_b", F.coalesce(F.sum("_c").over(W.partitionBy("target_id").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = mine.withColumn("_k", F.row_number().over(W.partitionBy("target_id", "_b").orderBy("_r", "_id")))
    return within.join(offsets, ["target_id", "_b"]).select("_id", "target_id", (F.col("_k") + F.col("_before")).alias("place"))


def draw(rows: DataFrame, targets: DataFrame, key: str = "hesum_id", categories: tuple[str, ...] = CATEGORIES, fraction: int = FRACTION, seed: str = SEED, start: int = START) -> DataFrame:
    """(``key``, target_id, repaired): the sample; ``start`` is the random start in 1/100 of a row (0 to 99)."""
    return _draw(rows, keep(quotas(rows, targets, key, categories, fraction), "quotas"), key, categories, seed, start)


def _draw(rows: DataFrame, quota: DataFrame, key: str, categories: tuple[str, ...], seed: str, start: int) -> DataFrame:
    ranked = keep(_ranked(rows, quota, key, categories, seed), "quota-places")
    assigned = ranked.groupBy("target_id").agg(F.count("*").alias("size"))
    w = quota.join(assigned, "target_id").select("target_id", "need", "size", F.least(F.col("pct") * F.col("n"), 100 * F.col("size")).alias("w"))
    begins = w.withColumn("s", F.coalesce(F.sum("w").over(W.orderBy("target_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per target
    on = ranked.join(F.broadcast(begins), "target_id")  # a row per target
    d = "CAST({} AS DECIMAL(38,0))"
    upto = lambda place: f"((({d.format('s')} + {100 - start}) * size + {d.format('w')} * {place}) div (100 * {d.format('size')}))"
    drawn = on.withColumn("hit", F.expr(f"{upto('place')} > {upto('(place - 1)')}"))
    got = drawn.groupBy("target_id").agg(F.count_if("hit").alias("got"), F.count_if(~F.col("hit")).alias("spare"))
    lack = got.join(w.select("target_id", "need"), "target_id").select("target_id", F.greatest(F.least(F.col("need") - F.col("got"), "spare"), F.lit(0)).alias("lack"))
    # the spare ids needed stand among the first got + lack places
    near = drawn.join(F.broadcast(lack.join(got, "target_id")), "target_id").where(F.col("hit") | (F.col("place") <= F.col("got") + F.col("lack")))
    # how many ids up to a place are spare follows from the crossings up to it, so no target is sorted in one task
    extra = near.where("NOT hit AND lack > 0").withColumn("k", F.expr(f"place - ({upto('place')} - {upto('0')})")).where("k <= lack")
    hits = drawn.where("hit").select("_id", "target_id", F.lit(False).alias("repaired"))
    return hits.unionByName(extra.select("_id", "target_id", F.lit(True).alias("repaired"))).withColumnRenamed("_id", key)


def report(rows: DataFrame, targets: DataFrame, key: str = "hesum_id", categories: tuple[str, ...] = CATEGORIES, fraction: int = FRACTION, seed: str = SEED, start: int = START) -> DataFrame:
    """Per target: need, ids available, ids drawn, ids added for the floor, and whether the target is met."""
    quota = keep(quotas(rows, targets, key, categories, fraction), "quotas")
    drawn = _draw(rows, quota, key, categories, seed, start).groupBy("target_id").agg(F.count("*").alias("drawn"), F.count_if("repaired").alias("repaired"))
    return quota.join(drawn, "target_id", "left").select(
        "target_id",
        "pct",
        "need",
        "available",
        F.coalesce("drawn", F.lit(0)).cast("bigint").alias("drawn"),
        F.coalesce("repaired", F.lit(0)).cast("bigint").alias("repaired"),
        (F.col("available") >= F.col("need")).alias("can_be_met"),
    )
