"""Rank statistics over ordinal scores. All start from small count tables, which partial aggregation makes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.schemas import LEVELS
from tallyloom.session import ship

#: The 97.5 % quantile of the normal distribution; shares and effects below which a difference is negligible.
Z95 = 1.959963984540054
DEGENERATE, NEGLIGIBLE = 0.85, 0.147


def level_counts(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by, score, n): the count table."""
    return df.groupBy(*by, score).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, by: list[str], score: str = "score", levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(by, level, n, share): counts per level, zero-filled, and the level's share in percent."""
    counts = [F.count_if(F.col(score) == v).alias(f"_{v}") for v in levels]
    one = df.groupBy(*by).agg(F.count(score).alias("_n"), *counts)
    rows = F.array(*(F.struct(F.lit(v).alias("level"), F.col(f"_{v}").alias("n")) for v in levels))
    out = one.select(*by, "_n", F.explode(rows).alias("r"))
    share = F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.round(F.col("r.n") * 100 / F.col("_n"), 4))
    return out.select(*by, "r.level", "r.n", share.alias("share"))


def medians(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by, n, median) from the count table: the mean of the middle two of an even number."""
    c = level_counts(df.where(F.col(score).isNotNull()), by, score)
    w = W.partitionBy(*by)
    run = c.withColumn("_to", F.sum("n").over(w.orderBy(score))).withColumn("_n", F.sum("n").over(w))
    at = lambda k: F.min(F.when(F.col("_to") >= k, F.col(score)))
    mid = run.groupBy(*by).agg(F.first("_n").alias("n"), at(F.floor((F.col("_n") + 1) / 2)).alias("_a"), at(F.floor((F.col("_n") + 2) / 2)).alias("_b"))
    return mid.select(*by, "n", ((F.col("_a") + F.col("_b")) / 2).alias("median"))


def cliffs_delta(counts: DataFrame, group: str, reference: str, by: list[str] | None = None, score: str = "score") -> DataFrame:
    """(group, by, n, n_reference, delta): each group against the reference group, from a count table (group, by, score, n)."""
    by = by or []
    a = counts.where(F.col(group) != reference)
    b = counts.where(F.col(group) == reference).select(*(F.col(c).alias("_r" + c) for c in by), F.col(score).alias("_s"), F.col("n").alias("_m"))
    on = F.lit(True)
    for c in by:
        on = on & (a[c] == b["_r" + c])
    na, nb = F.col("n").cast("double"), F.col("_m").cast("double")
    # both sides have a row per level: at most levels x levels rows per group
    pairs = a.join(F.broadcast(b), on)
    sides = counts.groupBy(group, *by).agg(F.sum("n").alias("_t"))
    signed = pairs.groupBy(group, *by).agg(F.sum(F.signum(F.col(score) - F.col("_s")) * na * nb).alias("_d"), F.sum(na * nb).alias("_p"))
    ref = sides.where(F.col(group) == reference).select(*(F.col(c).alias("_q" + c) for c in by), F.col("_t").alias("n_reference"))
    out = signed.join(sides, [group, *by])
    link = F.lit(True)
    for c in by:
        link = link & (F.col(c) == F.col("_q" + c))
    return out.join(F.broadcast(ref), link).select(group, *by, F.col("_t").alias("n"), "n_reference", F.round(F.col("_d") / F.col("_p"), 6).alias("delta"))


def delta_of(a: np.ndarray, b: np.ndarray) -> float:
    """Cliff's delta of two arrays of level counts; 0 if one is empty."""
    if not a.sum() or not b.sum():
        return 0.0
    below = np.concatenate([[0], np.cumsum(b)[:-1]])
    above = b.sum() - np.cumsum(b)
    return float((a * below - a * above).sum() / (a.sum() * b.sum()))


def bootstrap_delta(a: np.ndarray, b: np.ndarray, draws: int = 2000, seed: int = 0, alpha: float = 0.05) -> tuple[float, float]:
    """Percentile interval of delta; resampling values with replacement is drawing the level counts from a multinomial."""
    if not a.sum() or not b.sum():
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    x = rng.multinomial(int(a.sum()), a / a.sum(), draws).astype(float)
    y = rng.multinomial(int(b.sum()), b / b.sum(), draws).astype(float)
    below = np.cumsum(y, axis=1) - y
    above = y.sum(axis=1, keepdims=True) - np.cumsum(y, axis=1)
    d = (x * (below - above)).sum(axis=1) / (a.sum() * b.sum())
    return tuple(np.percentile(d, [100 * alpha / 2, 100 * (1 - alpha / 2)]).tolist())


def bootstrap_median(values: np.ndarray, draws: int = 500, seed: int = 0, alpha: float = 0.05) -> tuple[float, float]:
    """Percentile interval of the median of an array in its given order, with numpy's stream."""
    if not len(values):
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    m = np.median(rng.choice(np.asarray(values), size=(draws, len(values)), replace=True), axis=1)
    return tuple(np.percentile(m, [100 * alpha / 2, 100 * (1 - alpha / 2)]).tolist())


def bootstrap_median_counts(levels: np.ndarray, counts: np.ndarray, draws: int = 500, seed: int = 0, alpha: float = 0.05) -> tuple[float, float]:
    """As bootstrap_median, from sorted levels and their counts."""
    n = int(counts.sum())
    if not n:
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    upto = np.cumsum(rng.multinomial(n, counts / n, draws), axis=1)
    low = levels[(upto >= (n + 1) // 2).argmax(axis=1)]
    high = levels[(upto >= (n + 2) // 2).argmax(axis=1)]
    return tuple(np.percentile((low + high) / 2, [100 * alpha / 2, 100 * (1 - alpha / 2)]).tolist())


def delta_intervals(counts: DataFrame, group: str, reference: str, by: list[str], score: str = "score", draws: int = 2000, seed: int = 0) -> DataFrame:
    """(group, by, delta, low, high) per group against the reference; each task holds one count table of a few rows."""
    first = by[0]
    kinds = ", ".join(f"{c} string" for c in (group, *by))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = np.sort(pdf[score].unique())
        table = {}
        for g, part in pdf.groupby(group):
            n = part.groupby(score)["n"].sum()
            table[g] = np.array([n.get(v, 0) for v in levels], dtype=float)
        ref = table.get(reference, np.zeros(len(levels)))
        rows = [(g, *pdf[by].iloc[0], delta_of(a, ref), *bootstrap_delta(a, ref, draws, seed)) for g, a in sorted(table.items()) if g != reference]
        return pd.DataFrame(rows, columns=[group, *by, "delta", "low", "high"])

    out = counts.groupBy(*by).applyInPandas(run, f"{kinds}, delta double, low double, high double")
    return out.withColumn("negligible", F.abs("delta") < NEGLIGIBLE).select(group, *by, "delta", "low", "high", "negligible") if first else out


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson's interval in percent, 0 to 100; (0, 0) for n = 0."""
    n = n.cast("double")
    p = k / F.nullif(n, F.lit(0.0))
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = (p + z * z / (2 * n) - spread) / (1 + z * z / n)
    high = (p + z * z / (2 * n) + spread) / (1 + z * z / n)
    none = n == 0
    return F.when(none, 0.0).otherwise(100 * F.greatest(F.lit(0.0), low)), F.when(none, 0.0).otherwise(100 * F.least(F.lit(1.0), high))


def kappa(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, n, kappa): quadratically weighted, weights on the place of a label among those observed in the group.

    Closed form on sums over a count table; null where no disagreement is expected.
    """
    counts = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("n"))
    labels = F.array_sort(F.array_union(F.collect_set(a).over(W.partitionBy(*by)), F.collect_set(b).over(W.partitionBy(*by))))
    placed = counts.withColumn("_l", labels).withColumn("_i", F.array_position("_l", F.col(a))).withColumn("_j", F.array_position("_l", F.col(b)))
    s = lambda e: F.sum(F.expr(f"n * ({e})"))
    t = placed.groupBy(*by).agg(F.sum("n").alias("n"), s("(_i - _j) * (_i - _j)").alias("_o"), s("_i").alias("_si"), s("_j").alias("_sj"), s("_i * _i").alias("_ii"), s("_j * _j").alias("_jj"))
    expected = F.col("n") * F.col("_ii") + F.col("n") * F.col("_jj") - 2 * F.col("_si") * F.col("_sj")
    return t.select(*by, "n", F.round(1 - F.col("n").cast("double") * F.col("_o") / F.nullif(expected.cast("double"), F.lit(0.0)), 3).alias("kappa"))


def closeness(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, n, mean_a, mean_b, exact_pct, within_one_pct)."""
    d = F.abs(F.col(a) - F.col(b))
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(a), 3).alias("mean_a"),
        F.round(F.avg(b), 3).alias("mean_b"),
        F.round(100 * F.count_if(d == 0) / F.count("*"), 1).alias("exact_pct"),
        F.round(100 * F.count_if(d <= 1) / F.count("*"), 1).alias("within_one_pct"),
    )


def degenerate(df: DataFrame, by: list[str], score: str = "score", threshold: float = DEGENERATE) -> DataFrame:
    """(by, n, max_share, is_degenerate): one level holds nearly all scores, or there are none."""
    c = level_counts(df, by, score).groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col(score).isNotNull(), F.col("n"))), F.lit(0)).alias("n"), F.max(F.when(F.col(score).isNotNull(), F.col("n"))).alias("_m"))
    share = F.col("_m") / F.nullif(F.col("n"), F.lit(0))
    return c.select(*by, "n", F.round(share, 6).alias("max_share"), F.coalesce(share >= threshold, F.lit(True)).alias("is_degenerate"))


def transition_matrix(df: DataFrame, before: str, after: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(before, to_1 ... to_5): counts of level changes."""
    one = df.where(F.col(before).isin(*levels)).groupBy(F.col(before).alias("before"))
    return one.agg(*(F.count_if(F.col(after) == v).alias(f"to_{v}") for v in levels))


def binned(df: DataFrame, x: str, y: str, key: str, by: list[str] | None = None, bins: int = 16) -> DataFrame:
    """(by, bin, _x, _y): every row with an x, in one of ``bins`` bins of equal size by x, ties by key, then y.

    Ranks are exact without one global sort in one task: rows are counted per (x, leading hex digits of a hash of the key),
    a bounded table gives the offsets, and rows are ranked inside their slot.
    """
    by = by or []
    rows = df.where(F.col(x).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_h"), F.col(key).alias("_k"))
    rows = rows.withColumn("_s", F.substring("_h", 1, 2))
    slot = rows.groupBy(*by, "_x", "_s").agg(F.count("*").alias("_c"))
    # one window over (distinct x) times 256 rows, a summary, not the rows
    before = slot.select(*by, "_x", "_s", F.coalesce(F.sum("_c").over(W.partitionBy(*by).orderBy("_x", "_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    total = slot.groupBy(*by).agg(F.sum("_c").alias("_n"))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_x", "_s").orderBy("_h", "_k", "_y"))).join(before, [*by, "_x", "_s"])
    ranked = ranked.join(F.broadcast(total), by) if by else ranked.crossJoin(F.broadcast(total))
    place = F.col("_r") + F.col("_b") - 1
    big, rest = F.expr(f"_n div {bins}"), F.expr(f"_n % {bins}")
    wide = rest * (big + 1)
    number = F.when(place < wide, F.floor(place / (big + 1))).otherwise(rest + F.floor((place - wide) / F.greatest(big, F.lit(1)))) + 1
    return ranked.select(*by, number.cast("int").alias("bin"), "_x", "_y")


def quantile_bins(df: DataFrame, x: str, y: str, key: str, bins: int = 16, slots: int = 4096) -> DataFrame:
    """(bin, n, x_min, x_max, y_mean) of ``bins`` bins of equal size by x, ties by key."""
    rows = binned(df, x, y, key, bins=bins)
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.min("_x").alias("x_min"), F.max("_x").alias("x_max"), F.round(F.avg("_y"), 6).alias("y_mean"))


def median_of(levels: np.ndarray, counts: np.ndarray) -> float:
    """The median of sorted levels with their counts."""
    n, upto = int(counts.sum()), np.cumsum(counts)
    return float((levels[(upto >= (n + 1) // 2).argmax()] + levels[(upto >= (n + 2) // 2).argmax()]) / 2)


def bin_medians(df: DataFrame, x: str, y: str, key: str, by: list[str], bins: int = 16, draws: int = 500, seed: int = 0) -> DataFrame:
    """(by, bin, n, x_median, y_median, low, high): medians of ``bins`` bins of equal size by x, and y's bootstrap interval.

    A pair that lacks x or y is in no bin. Each task holds the counts of one bin's levels.
    """
    rows = binned(df.where(F.col(y).isNotNull()), x, y, key, by, bins)
    both = F.array(*(F.struct(F.lit(k).alias("kind"), F.col("_" + k).cast("double").alias("level")) for k in ("x", "y")))
    counts = rows.select(*by, "bin", F.explode(both).alias("v")).groupBy(*by, "bin", "v.kind", "v.level").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {k: p.sort_values("level") for k, p in pdf.groupby("kind")}
        (vx, nx), (vy, ny) = ((part[k]["level"].to_numpy(), part[k]["n"].to_numpy()) for k in ("x", "y"))
        row = (*pdf[[*by, "bin"]].iloc[0], int(ny.sum()), median_of(vx, nx), median_of(vy, ny), *bootstrap_median_counts(vy, ny, draws, seed))
        return pd.DataFrame([row], columns=[*by, "bin", "n", "x_median", "y_median", "low", "high"])

    ship(df.sparkSession)
    kinds = "".join(f"{c} string, " for c in by)
    return counts.groupBy(*by, "bin").applyInPandas(run, f"{kinds}bin int, n bigint, x_median double, y_median double, low double, high double")


def median_intervals(counts: DataFrame, by: list[str], score: str = "score", draws: int = 500, seed: int = 0) -> DataFrame:
    """(by, n, median, low, high): the median and its bootstrap interval, from a count table (by, score, n); null scores don't count."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.groupby(score)["n"].sum().sort_index()
        levels, n = c.index.to_numpy(dtype=float), c.to_numpy()
        row = (*pdf[by].iloc[0], int(n.sum()), median_of(levels, n), *bootstrap_median_counts(levels, n, draws, seed))
        return pd.DataFrame([row], columns=[*by, "n", "median", "low", "high"])

    ship(counts.sparkSession)
    kinds = "".join(f"{c} string, " for c in by)
    return counts.where(F.col(score).isNotNull()).groupBy(*by).applyInPandas(run, f"{kinds}n bigint, median double, low double, high double")
