"""Whole programs as functions over DataFrames: cleanup and dataset build, training data, pilot and validation reports.

Reports are long tables (section, who, dimension, measure, value), so their parts stay small aggregates that Spark joins
nowhere and a caller may pivot.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import agreement as A
from tallyloom.operators import boilerplate as B
from tallyloom.operators import ledger as L
from tallyloom.operators import quality as Q
from tallyloom.operators import statistics as S
from tallyloom.operators.sampling import mark
from tallyloom.schemas import SOURCE_LABELS

REPORT = ("section", "who", "dimension", "measure", "value")


def _part(df: DataFrame, section: str, who: str | None = None, dimension: str | None = None, **measures: Column | str) -> DataFrame:
    """Rows of a report from a small table: one per row and measure."""
    name = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    values = F.array(*(F.struct(F.lit(k).alias("measure"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("value")) for k, v in measures.items()))
    rows = df.select(F.lit(section).alias("section"), name(who).alias("who"), name(dimension).alias("dimension"), F.explode(values).alias("v"))
    return rows.select("section", "who", "dimension", "v.measure", "v.value")


def _report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---- dataset build ----


@dataclass
class Build:
    trimmed: DataFrame
    eligible: DataFrame
    final: DataFrame

    def counts(self, labels: DataFrame, replacements: DataFrame) -> DataFrame:
        """(step, n) of every step, in one row per step."""
        step = lambda name, df: df.agg(F.lit(name).alias("step"), F.count("*").alias("n"))
        usable = L.usable_ids(labels)
        named = labels.where(F.col("filter_label").isin(*SOURCE_LABELS)).groupBy("filter_label").agg(F.count("*").alias("n")).select(F.concat(F.lit("label "), "filter_label").alias("step"), "n")
        return _report(
            step("records", self.trimmed),
            step("tails trimmed", self.trimmed.where("tail_boilerplate_removed")),
            step("eligible", self.eligible),
            step("labelled", labels),
            named,
            step("usable", usable),
            step("kept", replacements.where("replacement_headline IS NULL")),
            step("rewritten", replacements.where("replacement_headline IS NOT NULL")),
            step("final", self.final),
        )


def clean(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trimmed, eligible): records without repeated tails, and those that the model stages read."""
    trimmed = B.trim_tails(records)
    return trimmed, L.model_input(trimmed)


def rebuild(records: DataFrame, labels: DataFrame, replacements: DataFrame) -> Build:
    """From raw records (id, text, headline) and supplied results to the final dataset."""
    trimmed, eligible = clean(records)
    return Build(trimmed, eligible, L.final_dataset(trimmed, labels, replacements))


# ---- training data ----

#: The prompt of a training row; the article goes in whole.
PROMPT = "Summarise the article in at most two sentences.\n\nArticle:\n{article}\n\nSummary:"


def training_rows(splits: DataFrame, template: str = PROMPT) -> DataFrame:
    """(split, text, summary, prompt, completion) of the rows of the splits whose text and summary aren't blank."""
    rows = splits.select("split", X.strip("text").alias("text"), X.strip("summary").alias("summary")).where("text <> '' AND summary <> ''")
    return rows.select("*", X.fill(template, article="text").alias("prompt"), F.col("summary").alias("completion"))


def training_check(rows: DataFrame) -> DataFrame:
    """check_splits, and per split the prompts that lack their text and the completions that aren't the summary."""
    more = rows.groupBy(F.col("split").alias("_s")).agg(
        F.count_if(~F.coalesce(F.contains("prompt", F.col("text")), F.lit(False))).alias("n_prompt_lacks_text"),
        F.count_if(~F.col("completion").eqNullSafe(F.col("summary"))).alias("n_other_completion"),
    )
    base = Q.check_splits(rows)
    return base.join(more, F.col("split").eqNullSafe(F.col("_s"))).drop("_s")


# ---- reports ----


def retest(rows: DataFrame, key: str, n: int = 60, seed: int = 43) -> DataFrame:
    """At most ``n`` rows, drawn by another seed than the sample."""
    return rows.orderBy(mark(key, seed), key).limit(n)


def pilot_report(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distributions, degenerate dimensions and test-retest kappa of two passes (hesum_id, dimension, score)."""
    shares = S.distribution(first, ["dimension"])
    both = first.select("hesum_id", "dimension", F.col("score").alias("a")).join(second.select("hesum_id", "dimension", F.col("score").alias("b")), ["hesum_id", "dimension"])
    return _report(
        _part(shares.withColumn("who", F.concat(F.lit("level "), "level")), "distribution", "who", "dimension", n="n"),
        _part(S.degenerate(first, ["dimension"]), "degenerate", None, "dimension", n="n", max_share="max_share", is_degenerate=F.col("is_degenerate").cast("int")),
        _part(S.kappa(both, ["dimension"]), "test-retest", None, "dimension", n="n", kappa="kappa"),
    )


def human_validation(log: DataFrame, tasks: DataFrame, judge: DataFrame | None = None, judge_outcomes: DataFrame | None = None, disjoint: bool = True, check_only: bool = False) -> DataFrame:
    """The report on human ratings: completion; kappa of each rater and of all against the judge; kappa of pairs of raters,
    unless their lists are disjoint; agreement on pairs; the win rate.

    ``tasks`` are (assigned_annotator, hesum_id, task); ``judge`` (hesum_id, dimension, score); ``judge_outcomes`` (hesum_id,
    outcome). Where all raters are taken together, an item rated by several has the last rater's scores.
    """
    done = A.completion(tasks, log, per_annotator=disjoint)
    parts = [_part(done, "completion", "annotator_id" if disjoint else None, None, expected="expected_tasks", submitted="submitted_tasks", missing="missing_tasks")]
    if check_only:
        return parts[0]
    scores, won = A.long_scores(log), A.outcomes(log)
    if judge is not None:
        pooled = scores.groupBy("hesum_id", "dimension").agg(F.max_by("score", "annotator_id").alias("score"))
        together = A.against(pooled, judge)
        parts.append(_part(S.kappa(A.against(scores, judge), ["annotator_id", "dimension"]), "judge and rater", "annotator_id", "dimension", n="n", kappa="kappa"))
        parts.append(_part(S.kappa(together, ["dimension"]), "judge and raters", None, "dimension", n="n", kappa="kappa"))
        parts.append(_part(S.closeness(together, ["dimension"]), "closeness", None, "dimension", mean_judge="mean_a", mean_raters="mean_b", exact_pct="exact_pct", within_one_pct="within_one_pct"))
    if not disjoint:
        pairs = S.kappa(A.rater_pairs(scores), ["rater_a", "rater_b", "dimension"]).withColumn("who", F.concat_ws(" and ", "rater_a", "rater_b"))
        parts.append(_part(pairs, "two raters", "who", "dimension", n="n", kappa="kappa"))
    if judge_outcomes is not None:
        place = F.create_map(*[F.lit(v) for p in (("original", 0), ("tie", 1), ("curated", 2)) for v in p])
        last = won.groupBy("annotator_id", "hesum_id").agg(F.max_by("outcome", "pos").alias("outcome"))
        both = last.join(judge_outcomes.select("hesum_id", F.col("outcome").alias("judged")), "hesum_id").select("annotator_id", place[F.col("outcome")].alias("a"), place[F.col("judged")].alias("b"))
        agreed = both.groupBy("annotator_id").agg(F.round(100 * F.count_if(F.col("a") == F.col("b")) / F.count("*"), 2).alias("pct"))
        parts.append(_part(agreed, "pairs agreed with judge", "annotator_id", None, percent_agreement="pct"))
        parts.append(_part(S.kappa(both, ["annotator_id"]), "pairs with judge", "annotator_id", None, n="n", kappa="kappa"))
    parts.append(_part(A.pairwise_rate(won), "win rate", None, None, n="n", curated="curated", tie="tie", non_tie_curated_pct="non_tie_curated_pct", wilson_low="wilson_low", wilson_high="wilson_high"))
    return _report(*parts)


def experiment_report(pairs: DataFrame, outcomes: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """The report on two arms: counts per level and means of ``pairs`` (dimension, raw, curated), and the win rate."""
    both = F.array(*(F.struct(F.lit(a).alias("arm"), F.col(a).alias("score")) for a in ("raw", "curated")))
    arms = pairs.select("dimension", F.explode(both).alias("p")).select("dimension", "p.arm", "p.score")
    levels = S.distribution(arms, ["arm", "dimension"]).withColumn("who", F.concat_ws(" ", "arm", "level"))
    parts = [
        _part(levels, "level", "who", "dimension", n="n"),
        _part(arms.groupBy("dimension", "arm").agg(F.avg("score").alias("m")), "mean", "arm", "dimension", mean_score=F.round("m", 6)),
        _part(A.pairwise_rate(outcomes), "win rate", None, None, n="n", non_tie_curated_pct="non_tie_curated_pct", wilson_low="wilson_low", wilson_high="wilson_high"),
    ]
    if intervals is not None:
        parts.append(_part(intervals, "delta", None, "dimension", delta="delta", low="low", high="high"))
    return _report(*parts)
