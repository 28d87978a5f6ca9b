"""Annotation logs: latest entries, pairs of raters, agreement, pairwise outcomes, completion against a worklist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import statistics as S
from tallyloom.schemas import DIMENSIONS, WINNERS

KEYS = ("annotator_id", "hesum_id", "task")


def latest(log: DataFrame) -> DataFrame:
    """The last entry per annotator, item and task: later or equal times replace, a missing time is the earliest, pos parts ties."""
    rest = [c for c in log.columns if c not in KEYS]
    at = F.struct(F.coalesce("submitted_at", F.lit("")).alias("t"), F.col("pos").alias("p"))
    one = log.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), at).alias("_r"))
    return one.select(*KEYS, *(F.col(f"_r.{c}").alias(c) for c in rest))


def long_scores(log: DataFrame) -> DataFrame:
    """(annotator_id, hesum_id, dimension, score) of the latest rubric entries, scores 1 to 5 only."""
    rows = latest(log.where("task = 'rubric'"))
    parts = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"scores.{d}").alias("score")) for d in DIMENSIONS))
    out = rows.select("annotator_id", "hesum_id", F.explode(parts).alias("p")).select("annotator_id", "hesum_id", "p.dimension", "p.score")
    return out.where("score BETWEEN 1 AND 5")


def rater_pairs(scores: DataFrame) -> DataFrame:
    """(rater_a, rater_b, hesum_id, dimension, a, b) of all raters of the same item, rater_a < rater_b. An item has at most one score per rater."""
    left = scores.select("hesum_id", "dimension", F.col("annotator_id").alias("rater_a"), F.col("score").alias("a"))
    right = scores.select("hesum_id", "dimension", F.col("annotator_id").alias("rater_b"), F.col("score").alias("b"))
    return left.join(right, ["hesum_id", "dimension"]).where("rater_a < rater_b")


def against(scores: DataFrame, judge: DataFrame) -> DataFrame:
    """Raters' scores beside the judge's (hesum_id, dimension, score)."""
    return scores.withColumnRenamed("score", "b").join(judge.select("hesum_id", "dimension", F.col("score").alias("a")), ["hesum_id", "dimension"])


def outcomes(log: DataFrame, losing: str = "original") -> DataFrame:
    """Pairwise entries with the outcome that the blind winner means; entries without a valid winner or slots are left out."""
    w = F.lower(X.strip("winner"))
    rows = log.where("task = 'pairwise'").withColumn("_w", w).where(F.col("_w").isin(*WINNERS) & F.col("slot_map").isNotNull())
    return rows.withColumn("outcome", X.arm_of("_w", F.coalesce(F.col("slot_map")["a"] == "curated", F.lit(False)), losing)).drop("_w")


def pairwise_rate(rows: DataFrame, by: list[str] | None = None, losing: str = "original") -> DataFrame:
    """Shares of wins and ties over all entries, and the winning share of the decided ones; null where none is decided."""
    by = by or []
    c, o, t = (F.count_if(F.col("outcome") == v) for v in ("curated", losing, "tie"))
    n = F.count("*")
    low, high = S.wilson(F.col("curated"), F.col("n_non_tie"))
    one = rows.groupBy(*by).agg(n.alias("n"), c.alias("curated"), o.alias(losing), t.alias("tie"), (c + o).alias("n_non_tie"))
    pct = lambda k, m: F.round(100 * F.col(k) / F.nullif(F.col(m), F.lit(0)), 1)
    return one.select(
        *by, "n", "curated", losing, "tie", "n_non_tie",
        pct("curated", "n").alias("curated_pct"), pct("tie", "n").alias("tie_pct"), pct("curated", "n_non_tie").alias("non_tie_curated_pct"),
        F.round(low, 4).alias("wilson_low"), F.round(high, 4).alias("wilson_high"),
        ((low > 50) | (high < 50)).alias("excludes_50"),
    )


def outcome_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, percent_agreement, quadratic_kappa, insufficient) of two tables (hesum_id, outcome), ordered original < tie < curated."""
    place = F.create_map(*[F.lit(x) for p in (("original", 0), ("tie", 1), ("curated", 2)) for x in p])
    both = a.select("hesum_id", place[F.col("outcome")].alias("a")).join(b.select("hesum_id", place[F.col("outcome")].alias("b")), "hesum_id")
    k = S.kappa(both.withColumn("g", F.lit(1)), ["g"]).select("kappa")
    one = both.agg(F.count("*").alias("n"), F.round(100 * F.count_if(F.col("a") == F.col("b")) / F.nullif(F.count("*"), F.lit(0)), 2).alias("percent_agreement"))
    return one.join(k, F.lit(True), "left").select("n", "percent_agreement", F.col("kappa").alias("quadratic_kappa"), (F.col("n") == 0).alias("insufficient"))


def expand_tasks(worklist: DataFrame, annotator: str | None = None) -> DataFrame:
    """(hesum_id, assigned_annotator, task) of a worklist of one row per list."""
    rows = worklist.select(F.explode("rows").alias("r")).select("r.hesum_id", "r.assigned_annotator", F.explode("r.tasks").alias("task"))
    return rows.where(F.col("assigned_annotator") == annotator) if annotator else rows


def completion(expected: DataFrame, log: DataFrame, per_annotator: bool = True) -> DataFrame:
    """Expected, submitted and missing tasks, per assigned annotator (disjoint lists) or overall."""
    if per_annotator:
        e = expected.select(F.col("assigned_annotator").alias("annotator_id"), "hesum_id", "task").distinct()
        done = log.select("annotator_id", "hesum_id", "task", F.lit(1).alias("d")).distinct()
        on, by = ["annotator_id", "hesum_id", "task"], ["annotator_id"]
    else:
        e = expected.select("hesum_id", "task").distinct()
        done = log.select("hesum_id", "task", F.lit(1).alias("d")).distinct()
        on, by = ["hesum_id", "task"], []
    return e.join(done, on, "left").groupBy(*by).agg(
        F.count("*").alias("expected_tasks"), F.count("d").alias("submitted_tasks"), F.count_if(F.col("d").isNull()).alias("missing_tasks"), (F.count_if(F.col("d").isNull()) == 0).alias("complete")
    )


def pool(tables: list[DataFrame]) -> DataFrame:
    """(hesum_id, scores) of several raters; the whole score of a later table replaces an earlier one's."""
    from functools import reduce

    ranked = [t.select("hesum_id", "scores", F.lit(i).alias("_k")) for i, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, ranked).groupBy("hesum_id").agg(F.max_by("scores", "_k").alias("scores"))


def decision(pairwise: DataFrame, interval: DataFrame) -> DataFrame:
    """The rule: the decided win rate excludes 50 %, or the faithfulness interval (low, high; one row or none) excludes 0."""
    one = interval.agg(F.coalesce(F.first((F.col("low") > 0) | (F.col("high") < 0)), F.lit(False)).alias("faithfulness_excludes_0"))
    both = pairwise.crossJoin(F.broadcast(one))  # one row each
    return both.withColumn("adopt", F.coalesce("excludes_50", F.lit(False)) | F.col("faithfulness_excludes_0"))
