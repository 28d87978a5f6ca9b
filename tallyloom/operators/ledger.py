"""Filters, the per-record ledger, the final dataset, coverage and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.schemas import SOURCE_LABELS

TOKEN_BUDGET, MAX_PIPES = 4000, 1


def within_budget(text_tokens: Column, headline_tokens: Column, budget: int = TOKEN_BUDGET) -> Column:
    return text_tokens + headline_tokens <= budget


def few_pipes(headline: Column | str, most: int = MAX_PIPES) -> Column:
    return X.count_pipes(headline) <= most


def keep_all(records: DataFrame, keeps: list[DataFrame]) -> DataFrame:
    """Records whose ``keep`` is true in every keep table (id, keep). A record missing from a table is an error when its row is read."""
    out = records
    for k, table in enumerate(keeps):
        table = table.select(F.col("id").alias(f"_i{k}"), F.col("keep").alias(f"_k{k}"), F.lit(True).alias(f"_p{k}"))
        out = out.join(table, out.id == table[f"_i{k}"], "left")
        ok = F.when(F.col(f"_p{k}").isNull(), F.raise_error(F.concat(F.lit("no filter value for id "), F.col("id")))).otherwise(F.col(f"_k{k}"))
        out = out.where(ok)
    return out.select(*records.columns)


def model_input(records: DataFrame) -> DataFrame:
    """What the source filter reads: records within budget and with few pipes."""
    ok = within_budget(X.token_count("text"), X.token_count("headline")) & F.coalesce(few_pipes("headline"), F.lit(True))
    return records.where(ok).select("id", "text", "headline")


def usable_ids(labels: DataFrame, strict: bool = False) -> DataFrame:
    """Ids of usable sources. ``strict`` refuses repeated ids and a table without any usable one."""
    if strict:
        per = labels.groupBy("id").agg(F.count("*").alias("c"), F.max(F.col("filter_label") == "usable").alias("u"))
        found = per.agg(F.count_if(F.col("c") > 1).alias("twice"), F.count_if("u").alias("usable")).first()
        if found.twice or not found.usable:
            raise ValueError(f"{found.twice} repeated ids, {found.usable} usable")
    return labels.where(F.col("filter_label") == "usable").select("id").distinct()


def final_dataset(records: DataFrame, labels: DataFrame, replacements: DataFrame) -> DataFrame:
    """Usable records with the replacement headline where there is one."""
    r = replacements.select(F.col("id").alias("_i"), "replacement_headline")
    return (
        records.join(usable_ids(labels), "id", "left_semi")
        .join(r, F.col("id") == F.col("_i"))
        .select(F.col("id").alias("hesum_id"), "text", F.coalesce("replacement_headline", "headline").alias("headline"))
    )


def ledger(records: DataFrame, labels: DataFrame, replacements: DataFrame, budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row per record: every filter decision and label. A present null replacement means kept, an absent one nothing.

    ``records`` have id, text, headline, tail_boilerplate_removed; ``labels`` id, filter_label; ``replacements`` id,
    replacement_headline; each with unique ids. Texts are projected to counts before the joins shuffle.
    """
    wide = records.select(
        F.col("id").alias("hesum_id"),
        X.token_count("text").alias("article_tokens"),
        X.token_count("headline").alias("headline_tokens"),
        F.coalesce(X.count_pipes("headline"), F.lit(0)).alias("n_pipes"),
        "headline",
        "tail_boilerplate_removed",
        X.lead_overlap("text", "headline").alias("headline_lead_overlap"),
    )
    lab = labels.select(F.col("id").alias("_l"), F.col("filter_label").alias("source_label"), F.lit(True).alias("_reached"))
    rep = replacements.select(F.col("id").alias("_r"), "replacement_headline", F.lit(True).alias("_present"))
    joined = wide.join(lab, F.col("hesum_id") == F.col("_l"), "left").join(rep, F.col("hesum_id") == F.col("_r"), "left")
    return joined.select(
        "hesum_id",
        "article_tokens",
        "headline_tokens",
        "n_pipes",
        (~within_budget(F.col("article_tokens"), F.col("headline_tokens"), budget)).alias("over_token_budget"),
        (F.col("n_pipes") > MAX_PIPES).alias("multi_pipe"),
        "tail_boilerplate_removed",
        "source_label",
        F.coalesce("_reached", F.lit(False)).alias("reached_model_curation"),
        F.when(F.col("_present"), F.when(F.col("replacement_headline").isNull(), "kept").otherwise("rewritten")).alias("headline_action"),
        F.when(F.col("_present"), X.classify_edit("headline", "replacement_headline")).alias("headline_edit_type"),
        "headline_lead_overlap",
    )


def funnel(rows: DataFrame) -> DataFrame:
    """The curation funnel, one row, one pass over a ledger."""
    c = lambda e: F.count_if(F.expr(e))
    return rows.agg(
        F.count("*").alias("total"),
        c("tail_boilerplate_removed").alias("tail_boilerplate_removed"),
        c("over_token_budget AND NOT multi_pipe").alias("over_budget_only"),
        c("multi_pipe AND NOT over_token_budget").alias("multi_pipe_only"),
        c("over_token_budget AND multi_pipe").alias("both"),
        c("reached_model_curation").alias("reached"),
        c("source_label = 'usable'").alias("usable"),
        c("reached_model_curation AND source_label <> 'usable'").alias("unusable"),
        c("headline_action = 'kept'").alias("kept"),
        c("headline_action = 'rewritten'").alias("rewritten"),
    )


def funnel_links(rows: DataFrame) -> DataFrame:
    """(source, target, value): the funnel as links of a flow diagram."""
    one = funnel(rows)
    removed = F.col("over_budget_only") + F.col("multi_pipe_only") + F.col("both")
    links = [
        ("all records", "over budget only", F.col("over_budget_only")),
        ("all records", "several pipes only", F.col("multi_pipe_only")),
        ("all records", "both", F.col("both")),
        ("all records", "model curation", F.col("total") - removed),
        ("model curation", "unusable", F.col("unusable")),
        ("model curation", "usable", F.col("usable")),
        ("usable", "kept", F.col("kept")),
        ("usable", "rewritten", F.col("rewritten")),
    ]
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), v.alias("value")) for a, b, v in links))).alias("l")).select("l.*")


def reconcile(rows: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(name, expected, actual, agrees) for counts that a run must reproduce."""
    conditions = {
        "total": "true",
        "tail_boilerplate_removed": "tail_boilerplate_removed",
        "over_token_budget": "over_token_budget",
        "multi_pipe": "multi_pipe",
        "reached_model_curation": "reached_model_curation",
        "usable": "source_label = 'usable'",
        "unusable": "reached_model_curation AND source_label <> 'usable'",
        "headline_kept": "headline_action = 'kept'",
        "headline_rewritten": "headline_action = 'rewritten'",
    }
    one = rows.agg(*(F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()))
    want = lambda n: F.lit(expected.get(n)).cast("bigint")
    parts = F.array(*(F.struct(F.lit(n).alias("name"), want(n).alias("expected"), F.col(n).alias("actual"), (F.col(n) == want(n)).alias("agrees")) for n in conditions))
    return one.select(F.explode(parts).alias("p")).select("p.*")


def label_counts(labels: DataFrame) -> DataFrame:
    """Rows per source label, zero-filled over the known labels; others and null are listed as found."""
    known = labels.sparkSession.createDataFrame([(x,) for x in SOURCE_LABELS], "filter_label string")
    found = labels.groupBy("filter_label").agg(F.count("*").alias("c"))
    return known.select("filter_label", F.lit(0).cast("bigint").alias("c")).unionByName(found).groupBy("filter_label").agg(F.sum("c").alias("n"))


#: Analysis strata over the ledger; they may overlap. S5 is in the table only.
STRATA = {
    "S0": ("usable source; original headline kept", "reached_model_curation AND source_label = 'usable' AND headline_action = 'kept'"),
    "S2": ("headline contains at least two pipe separators", "multi_pipe"),
    "S3": ("multiple independent items", "source_label = 'unusable_multiple_independent_items'"),
    "S4": ("headline rewritten during curation", "headline_action = 'rewritten'"),
    "S5": ("other unusable-source labels", "source_label IS NOT NULL AND source_label NOT IN ('usable', 'unusable_multiple_independent_items')"),
}


def strata_table(rows: DataFrame) -> DataFrame:
    """(stratum, criterion, n)."""
    one = rows.agg(*(F.count_if(F.expr(c)).alias(s) for s, (_, c) in STRATA.items()))
    parts = F.array(*(F.struct(F.lit(s).alias("stratum"), F.lit(text).alias("criterion"), F.col(s).alias("n")) for s, (text, _) in STRATA.items()))
    return one.select(F.explode(parts).alias("p")).select("p.*")


def in_strata(rows: DataFrame, strata: tuple[str, ...] = ("S0", "S2", "S3", "S4")) -> DataFrame:
    """One row per row and stratum it belongs to."""
    member = F.array(*(F.when(F.expr(STRATA[s][1]), F.lit(s)) for s in strata))
    return rows.withColumn("stratum", F.explode(F.array_compact(member)))


def coverage(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """(n_left, n_right, n_both, n_missing, n_extra) of two id sets."""
    a = left.select(F.col(key).alias("_a")).distinct()
    b = right.select(F.col(key).alias("_b")).distinct()
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").agg(
        F.count("_a").alias("n_left"),
        F.count("_b").alias("n_right"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
        F.count_if(F.col("_b").isNull()).alias("n_missing"),
        F.count_if(F.col("_a").isNull()).alias("n_extra"),
    )


def duplicate_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n, first_repeat): ids that repeat and the place of their first repeat. Only minima are kept per id."""
    first = df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("_m")).where("n > 1")
    again = df.select(F.col(key).alias("_k"), F.col(order).alias("_o"))
    same = again.join(first, F.col("_k").eqNullSafe(F.col(key))).where("_o > _m")
    return same.groupBy(key).agg(F.first("n").alias("n"), F.min("_o").alias("first_repeat"))


def training_records(df: DataFrame, id_columns: tuple[str, ...] = ("hesum_id", "id"), summary: tuple[str, ...] = ("summary", "headline")) -> DataFrame:
    """(text, summary, source, hesum_id), stripped; rows with a blank text or summary are skipped."""
    pick = lambda names: F.coalesce(*(F.col(c).cast("string") for c in names if c in df.columns))
    source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    out = df.select(X.strip("text").alias("text"), X.strip(pick(summary)).alias("summary"), source.alias("source"), pick(id_columns).alias("hesum_id"))
    return out.where("text <> '' AND summary <> ''")
