"""One query per operator, over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import agreement as A
from tallyloom.operators import boilerplate as B
from tallyloom.operators import joins as N
from tallyloom.operators import judge as J
from tallyloom.operators import ledger as L
from tallyloom.operators import quality as Q
from tallyloom.operators import sampling as P
from tallyloom.operators import statistics as S
from tallyloom.plans import pipelines as R
from tallyloom.schemas import DIMENSIONS, EDIT_TYPES, SOURCE_LABELS
from tallyloom.session import table as t
from tallyloom.sources import files as I
from tallyloom.streaming import ingest as M

Query = Callable[[SparkSession, str], DataFrame]


# ---- inputs ----


def records(s: SparkSession, d: str) -> DataFrame:
    """The first delivery of each record."""
    read = t(s, d, "records").select("id", "pos", "text", "headline", "source").where("id IS NOT NULL")
    return N.first_per(read, "id", "pos")


def rows(s: SparkSession, d: str) -> DataFrame:
    """The ledger without repeated rows."""
    return t(s, d, "row_labels").distinct()


def labels(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d).where("reached_model_curation").groupBy(F.col("hesum_id").alias("id")).agg(F.max("source_label").alias("filter_label"))


def replacements(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "headline_target_curation_results").groupBy("id").agg(F.min("replacement_headline").alias("replacement_headline"))


def log(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "annotations")


def pooled(s: SparkSession, d: str) -> DataFrame:
    """(hesum_id, dimension, score): the rounded mean of all raters, which stands in for a judge."""
    return A.long_scores(log(s, d)).groupBy("hesum_id", "dimension").agg(F.round(F.avg("score")).cast("int").alias("score"))


def stratum_scores(s: SparkSession, d: str) -> DataFrame:
    """(stratum, dimension, score): raters' scores fanned out to every stratum of their item."""
    member = L.in_strata(rows(s, d)).select("hesum_id", "stratum").distinct()
    return A.long_scores(log(s, d)).join(member, "hesum_id").select("stratum", "dimension", "score")


def arms(s: SparkSession, d: str) -> DataFrame:
    """(hesum_id, dimension, raw, curated): an item's lowest and highest score, as two arms."""
    g = A.long_scores(log(s, d)).groupBy("hesum_id", "dimension").agg(F.min("score").alias("raw"), F.max("score").alias("curated"), F.count("*").alias("c"))
    return g.where("c > 1").drop("c")


def arm_scores(s: SparkSession, d: str) -> DataFrame:
    a = arms(s, d)
    both = F.array(F.struct(F.lit("raw").alias("arm"), F.col("raw").alias("score")), F.struct(F.lit("curated").alias("arm"), F.col("curated").alias("score")))
    return a.select("dimension", F.explode(both).alias("p")).select("dimension", "p.arm", "p.score")


# ---- queries ----


def word_extract(s: SparkSession, d: str) -> DataFrame:
    w = t(s, d, "records").select("pos", X.script_words("text").alias("w"))
    return w.select("pos", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"), F.array_join(F.slice("w", 1, 3), " ").alias("lead"))


def word_spans(s: SparkSession, d: str) -> DataFrame:
    """The spans of all words of all texts, summed up per record."""
    spans = X.word_spans(records(s, d), "id", "text")
    return spans.groupBy("id").agg(F.count("*").alias("n_words"), F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))


def tail_trim_summary(s: SparkSession, d: str) -> DataFrame:
    before = records(s, d).select("id", "text")
    after = B.trim_tails(before)
    n = F.char_length("text")
    return after.groupBy("tail_boilerplate_removed").agg(F.count("*").alias("n_records"), F.sum(n).alias("n_chars"), F.min(n).alias("least_chars"))


def curation_keep(s: SparkSession, d: str) -> DataFrame:
    r = rows(s, d).select(F.col("hesum_id").alias("id"), "article_tokens", "headline_tokens", "n_pipes")
    budget = r.select("id", L.within_budget(F.col("article_tokens"), F.col("headline_tokens")).alias("keep"))
    pipes = r.select("id", (F.col("n_pipes") <= L.MAX_PIPES).alias("keep"))
    return L.keep_all(r.select("id"), [budget, pipes])


def ledger_of(s: SparkSession, d: str) -> DataFrame:
    r = records(s, d)
    trimmed = r.join(B.tail_members(r.select("id", "text")).select("id", F.lit(True).alias("_t")), "id", "left").withColumn("tail_boilerplate_removed", F.coalesce("_t", F.lit(False)))
    return L.ledger(trimmed, labels(s, d), replacements(s, d))


def edit_class(s: SparkSession, d: str) -> DataFrame:
    j = records(s, d).select("id", "headline").join(replacements(s, d).where("replacement_headline IS NOT NULL"), "id")
    return j.select("id", X.classify_edit("headline", "replacement_headline").alias("edit_type"))


def pilot_sample(s: SparkSession, d: str) -> DataFrame:
    member = L.in_strata(rows(s, d)).select("hesum_id", "stratum").distinct()
    chosen = P.sample(member, "hesum_id", 75, by=["stratum"])
    return chosen.join(records(s, d).select(F.col("id").alias("hesum_id"), F.char_length("text").alias("n_chars")), "hesum_id").select("hesum_id", "stratum", "n_chars")


def lead_bias(s: SparkSession, d: str) -> DataFrame:
    x = rows(s, d).select("hesum_id", F.round(F.ln(F.greatest("article_tokens", F.lit(1))), 6).alias("log_tokens"))
    y = pooled(s, d).where("dimension = 'faithfulness'").select("hesum_id", "score")
    return S.quantile_bins(y.join(x, "hesum_id"), "log_tokens", "score", "hesum_id")


def lead_bias_bins(s: SparkSession, d: str) -> DataFrame:
    """Binned medians by log article tokens: pooled scores of every dimension, and the lead overlap of all rows."""
    r = rows(s, d).where("article_tokens IS NOT NULL").select("hesum_id", F.round(F.ln(F.greatest("article_tokens", F.lit(1))), 6).alias("log_tokens"), "headline_lead_overlap")
    scores = pooled(s, d).join(r, "hesum_id").select(F.col("dimension").alias("series"), "hesum_id", "log_tokens", F.col("score").cast("double").alias("y"))
    overlap = r.select(F.lit("headline_lead_overlap").alias("series"), "hesum_id", "log_tokens", F.col("headline_lead_overlap").alias("y"))
    return S.bin_medians(scores.union(overlap), "log_tokens", "y", "hesum_id", ["series"])


def e1_summary(s: SparkSession, d: str) -> DataFrame:
    scores = stratum_scores(s, d)
    counts = S.level_counts(scores, ["stratum", "dimension"])
    delta = S.cliffs_delta(counts, "stratum", "S0", ["dimension"]).select("stratum", "dimension", "delta")
    return S.medians(scores, ["stratum", "dimension"]).join(delta, ["stratum", "dimension"], "left").select("stratum", "dimension", "n", "median", "delta")


def e1_intervals(s: SparkSession, d: str) -> DataFrame:
    return S.delta_intervals(S.level_counts(stratum_scores(s, d), ["stratum", "dimension"]), "stratum", "S0", ["dimension"])


def rubric_paired(s: SparkSession, d: str) -> DataFrame:
    means = arms(s, d).groupBy("dimension").agg(
        F.count("*").alias("n"), F.round(F.avg("raw"), 3).alias("raw_mean"), F.round(F.avg("curated"), 3).alias("curated_mean"), F.round(F.avg(F.col("curated") - F.col("raw")), 3).alias("mean_difference")
    )
    delta = S.cliffs_delta(S.level_counts(arm_scores(s, d), ["arm", "dimension"]), "arm", "raw", ["dimension"])
    return means.join(delta.select("dimension", F.round("delta", 4).alias("cliffs_delta_unpaired")), "dimension")


def rubric_paired_intervals(s: SparkSession, d: str) -> DataFrame:
    """rubric_paired with the interval of every dimension's delta."""
    ci = S.delta_intervals(S.level_counts(arm_scores(s, d), ["arm", "dimension"]), "arm", "raw", ["dimension"])
    excludes = (F.col("high") < 0) | (F.col("low") > 0)
    return rubric_paired(s, d).join(ci.select("dimension", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), excludes.alias("ci_excludes_0")), "dimension")


def rater_kappa(s: SparkSession, d: str) -> DataFrame:
    pairs = A.rater_pairs(A.long_scores(log(s, d)))
    return S.kappa(pairs, ["rater_a", "rater_b", "dimension"]).where("n >= 2")


def outcome_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The outcome of the last entry per item in log order, and of the first."""
    o = A.outcomes(log(s, d))
    return o.groupBy("hesum_id").agg(F.max_by("outcome", "pos").alias("outcome")), o.groupBy("hesum_id").agg(F.min_by("outcome", "pos").alias("outcome"))


def decision_rule(s: SparkSession, d: str) -> DataFrame:
    counts = S.level_counts(arm_scores(s, d), ["arm", "dimension"]).where("dimension = 'faithfulness'")
    return A.decision(A.pairwise_rate(A.outcomes(log(s, d))), S.delta_intervals(counts, "arm", "raw", ["dimension"]))


def completion_check(s: SparkSession, d: str) -> DataFrame:
    entries = log(s, d)
    names = entries.where("annotator_id IS NOT NULL AND hesum_id IS NOT NULL")
    # the list asks every annotator for both tasks of each item that they have any entry for
    tasks = names.select("annotator_id", "hesum_id").distinct().select(F.col("annotator_id").alias("assigned_annotator"), "hesum_id", F.explode(F.array(F.lit("rubric"), F.lit("pairwise"))).alias("task"))
    return A.completion(tasks, entries)


def judge_replies(s: SparkSession, d: str) -> DataFrame:
    """Replies as a judge writes them, made from the logged rubric scores."""
    parts = [F.format_string('"%s": {"score": %s, "justification": "x"}', F.lit(c), F.coalesce(F.col(f"scores.{c}").cast("string"), F.lit("null"))) for c in DIMENSIONS]
    return log(s, d).where("task = 'rubric'").select("pos", F.concat(F.lit("here {"), F.concat_ws(", ", *parts), F.lit("} done")).alias("reply"))


def judge_reply_parse(s: SparkSession, d: str) -> DataFrame:
    m = judge_replies(s, d).select("pos", Q.parse_rubric("reply").alias("m"))
    return m.select("pos", F.size("m").alias("n_scores"), *(F.col("m")[c].alias(c) for c in DIMENSIONS))


def winner_reply_parse(s: SparkSession, d: str) -> DataFrame:
    raw = log(s, d).where("task = 'pairwise'").select("pos", F.concat(F.lit("x "), F.to_json(F.struct("winner")), F.lit(" y")).alias("raw"))
    return raw.select("pos", Q.parse_winner("raw").alias("winner"))


def batch_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of a batch's output, made from the labels: some with an HTTP error, some incomplete, some without an object."""
    k = F.pmod(F.length("id") + F.ascii(F.substring("id", -1, 1)), F.lit(7))
    text = F.when(k == 0, F.lit("no object")).otherwise(F.to_json(F.struct("id", F.col("filter_label").alias("label"))))
    body = F.struct(F.when(k == 1, "incomplete").otherwise("completed").alias("status"), F.array(F.struct(F.array(F.struct(text.alias("text"))).alias("content"))).alias("output"))
    line = F.struct(F.concat(F.lit("c-"), "id").alias("custom_id"), F.struct(F.when(k == 2, 500).otherwise(200).alias("status_code"), body.alias("body")).alias("response"))
    return labels(s, d).select("id", F.to_json(line).alias("value"))


def batch_parse(s: SparkSession, d: str) -> DataFrame:
    p = batch_lines(s, d).select(Q.parse_batch_line("value").alias("p")).select("p.*")
    return p.select("custom_id", "error", F.get_json_object("data", "$.label").alias("label"))


def incremental_ingest(s: SparkSession, d: str) -> DataFrame:
    """Two runs over the same lines: the second one must add nothing."""
    import uuid

    from tallyloom.session import shared_dir

    root = f"{shared_dir(s).rstrip('/')}/tallyloom-ingest-{uuid.uuid4().hex}"
    batch_lines(s, d).select("value").repartition(3).write.text(f"{root}/in")
    for _ in range(2):
        M.ingest(s, f"{root}/in", f"{root}/ok", f"{root}/bad", f"{root}/checkpoint", files_per_batch=2)
    done = s.read.schema(M.RESULTS).parquet(f"{root}/ok").select(F.lit("done").alias("state"))
    failed = s.read.schema(M.FAILURES).parquet(f"{root}/bad").select("error").withColumnRenamed("error", "state")
    return done.union(failed).groupBy("state").agg(F.count("*").alias("n"))


def resume_choice(s: SparkSession, d: str) -> DataFrame:
    names = [(4, ("trainer_state.json", "optimizer.pt", "scheduler.pt", "model.safetensors")), (12, ("trainer_state.json", "optimizer.pt", "scheduler.pt", "adapter_model.safetensors")), (20, ("trainer_state.json", "adapter_model.safetensors"))]
    paths = [(f"run/checkpoint-{n}/{f}",) for n, fs in names for f in fs] + [(f"run/checkpoint-last/{f}",) for f in names[0][1]]
    return Q.resume_choice(s.createDataFrame(paths, "path string"))


def judged_records(s: SparkSession, d: str) -> DataFrame:
    """Records through a stand-in model: prompt, reply, parsed scores."""
    base = records(s, d).where("text IS NOT NULL AND headline IS NOT NULL")
    asked = base.select("id", X.fill("Article:\n{article}\nHeadline: {headline}", article=X.prefix("text", J.ARTICLE_CHARS), headline="headline").alias("prompt"))
    replied = J.ask(asked, "prompt", J.fake_scorer)
    return replied.select("id", F.size(Q.parse_rubric("raw_reply")).alias("n_scores"), Q.parse_rubric("raw_reply")["faithfulness"].alias("faithfulness"))


def training_pool(s: SparkSession, d: str) -> DataFrame:
    raw = records(s, d).where("text IS NOT NULL").withColumnRenamed("id", "hesum_id")
    held = t(s, d, "curated_records").where("split IN ('val', 'test')").select("hesum_id")
    return P.training_pool(raw, held, 500).select("hesum_id", "pos")


def split_counts(s: SparkSession, d: str) -> DataFrame:
    return P.split(records(s, d).select("id"), "id").groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("least_id"))


def pair_arms(s: SparkSession, d: str) -> DataFrame:
    """One model's predictions as an arm against all others'."""
    p = t(s, d, "predictions_curated")
    pairs = P.pair_by_text(p.where("model = 'student-3b'"), p.where("NOT model <=> 'student-3b'"), ["prediction"])
    return pairs.agg(F.count("*").alias("n_texts"), *(F.count_if(F.expr(e)).alias(n) for n, e in (("n_paired", "n_a > 0 AND n_b > 0"), ("only_b", "n_a = 0"), ("only_a", "n_b = 0"), ("n_repeated", "n_a > 1 OR n_b > 1"))))


def rebuild_counts(s: SparkSession, d: str) -> DataFrame:
    lab, rep = labels(s, d), replacements(s, d)
    return R.rebuild(records(s, d).select("id", "text", "headline"), lab, rep).counts(lab, rep)


def pilot_report(s: SparkSession, d: str) -> DataFrame:
    """The pooled scores of a stratified sample as the first pass, the least of the raters' scores of 60 as the second."""
    member = L.in_strata(rows(s, d)).select("hesum_id", "stratum").distinct()
    chosen = P.sample(member, "hesum_id", 75, by=["stratum"]).select("hesum_id").distinct()
    least = A.long_scores(log(s, d)).groupBy("hesum_id", "dimension").agg(F.min("score").alias("score"))
    return R.pilot_report(pooled(s, d).join(chosen, "hesum_id", "left_semi"), least.join(R.retest(chosen, "hesum_id"), "hesum_id", "left_semi"))


def human_validation(s: SparkSession, d: str) -> DataFrame:
    entries = log(s, d)
    names = entries.where("annotator_id IS NOT NULL AND hesum_id IS NOT NULL")
    tasks = names.select("annotator_id", "hesum_id").distinct().select(F.col("annotator_id").alias("assigned_annotator"), "hesum_id", F.explode(F.array(F.lit("rubric"), F.lit("pairwise"))).alias("task"))
    return R.human_validation(entries, tasks, pooled(s, d), outcome_tables(s, d)[1])


def generation_resume(s: SparkSession, d: str) -> DataFrame:
    """Two runs over the records, the first stopped early: every record has one reply in the end."""
    import uuid

    from tallyloom.session import shared_dir

    path = f"{shared_dir(s).rstrip('/')}/tallyloom-generated-{uuid.uuid4().hex}"
    asked = records(s, d).where("headline IS NOT NULL").select("id", X.fill("Headline: {headline}", headline="headline").alias("prompt"))
    make = lambda df: J.ask(df, "prompt", J.fake_scorer).select("id", F.md5("raw_reply").alias("reply_md5"))
    M.resume(asked.where("id < '5'"), "id", path, make)
    done = M.resume(asked, "id", path, make)
    return done.agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"))


def id_sets(s: SparkSession, d: str) -> DataFrame:
    """Set operations on the ids of records, labels and results."""
    r, c = records(s, d).select("id").distinct(), replacements(s, d).select("id")
    x = labels(s, d).select("id")
    one = lambda name, df: df.agg(F.lit(name).alias("operation"), F.count("*").alias("n"))
    return one("difference", r.exceptAll(c)).union(one("intersection", x.intersect(c))).union(one("union", x.union(c).distinct())).union(one("union_all", x.unionByName(c)))


def queries() -> dict[str, Query]:
    return {
        # text
        "word_extract": word_extract,
        "word_spans": word_spans,
        "lead_overlap": lambda s, d: t(s, d, "records").select("pos", X.lead_overlap("text", "headline").alias("overlap")),
        "pipe_filter": lambda s, d: t(s, d, "records").select("pos", X.count_pipes("headline").alias("n_pipes"), L.few_pipes("headline").alias("keep")),
        "token_budget": lambda s, d: t(s, d, "records").select("pos", X.token_count("text").alias("article_tokens"), X.token_count("headline").alias("headline_tokens"), L.within_budget(X.token_count("text"), X.token_count("headline")).alias("keep")),
        "strip_think": lambda s, d: t(s, d, "predictions_curated").select("pos", X.strip_think("prediction").alias("answer")),
        "clean_nullable": lambda s, d: t(s, d, "documents").select("doc_id", F.char_length(X.clean_nullable("text")).alias("n_chars_clean")),
        "text_prefix": lambda s, d: t(s, d, "records").select("pos", X.prefix("text", 80).alias("text_prefix"), F.char_length(X.prefix("text", J.ARTICLE_CHARS)).alias("n_chars")),
        "truncate_tokens": lambda s, d: t(s, d, "records").select("pos", X.truncate_tokens("headline", 4).alias("short_headline")),
        "prompt_render": lambda s, d: t(s, d, "records").select("pos", F.md5(X.fill("Article:\n{article}\n\nHeadline: {headline}\n", article=X.prefix("text", J.ARTICLE_CHARS), headline="headline")).alias("prompt_md5")),
        "edit_class": edit_class,
        "edit_class_counts": lambda s, d: edit_class(s, d).groupBy("edit_type").agg(F.count("*").alias("n")),
        "gap_metadata": lambda s, d: t(s, d, "records").select("pos", X.gap_is_metadata("headline").alias("is_metadata")),
        # repeated tails
        "tail_candidates": lambda s, d: B.tail_candidates(records(s, d).select("id", "text")),
        "longest_tail": lambda s, d: B.tail_members(records(s, d).select("id", "text")).select("id", "tail", "length"),
        "tail_trim_summary": tail_trim_summary,
        # filters, ledger, dataset
        "curation_keep": curation_keep,
        "model_input": lambda s, d: L.model_input(records(s, d)).select("id", "headline"),
        "usable_ids": lambda s, d: L.usable_ids(labels(s, d)),
        "final_dataset": lambda s, d: L.final_dataset(records(s, d), labels(s, d), replacements(s, d)).select("hesum_id", "headline", F.md5("text").alias("text_md5")),
        "training_records": lambda s, d: L.training_records(t(s, d, "curated_records")).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.char_length("summary")).alias("n_chars")),
        "ledger": ledger_of,
        "curation_funnel": lambda s, d: L.funnel(rows(s, d)),
        "funnel_links": lambda s, d: L.funnel_links(rows(s, d)),
        "ledger_reconciliation": lambda s, d: L.reconcile(rows(s, d), {"total": 1500}),
        "label_counts": lambda s, d: L.label_counts(labels(s, d)),
        "strata_table": lambda s, d: L.strata_table(rows(s, d)),
        "stratum_members": lambda s, d: L.in_strata(rows(s, d)).select("hesum_id", "stratum"),
        "coverage_check": lambda s, d: L.coverage(labels(s, d), replacements(s, d)),
        "enum_check": lambda s, d: Q.check_enum(t(s, d, "row_labels"), "headline_edit_type", EDIT_TYPES),
        "label_enum_check": lambda s, d: Q.check_enum(t(s, d, "row_labels"), "source_label", SOURCE_LABELS),
        "headline_stage_input": lambda s, d: records(s, d).join(L.usable_ids(labels(s, d)), "id", "left_semi").select("id", "headline"),
        "duplicate_ids": lambda s, d: L.duplicate_ids(t(s, d, "records"), "id", "pos"),
        "id_sets": id_sets,
        # scores
        "score_distribution": lambda s, d: S.distribution(A.long_scores(log(s, d)), ["dimension"]),
        "share_by_level": lambda s, d: S.distribution(stratum_scores(s, d), ["stratum", "dimension"]),
        "median_by_stratum": lambda s, d: S.medians(stratum_scores(s, d), ["stratum", "dimension"]),
        "cliffs_delta": lambda s, d: S.cliffs_delta(S.level_counts(stratum_scores(s, d), ["stratum", "dimension"]), "stratum", "S0", ["dimension"]),
        "e1_summary": e1_summary,
        "e1_intervals": e1_intervals,
        "arm_means": lambda s, d: arm_scores(s, d).groupBy("dimension", "arm").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score")),
        "rubric_paired": rubric_paired,
        "rubric_paired_intervals": rubric_paired_intervals,
        "median_intervals": lambda s, d: S.median_intervals(S.level_counts(stratum_scores(s, d), ["stratum", "dimension"]), ["stratum", "dimension"]),
        "degenerate_dimension": lambda s, d: S.degenerate(stratum_scores(s, d), ["stratum", "dimension"]),
        "transition_matrix": lambda s, d: S.transition_matrix(arms(s, d), "raw", "curated"),
        "kappa": rater_kappa,
        "judge_kappa": lambda s, d: S.kappa(A.against(A.long_scores(log(s, d)), pooled(s, d)), ["annotator_id", "dimension"]),
        "closeness": lambda s, d: S.closeness(A.against(A.long_scores(log(s, d)), pooled(s, d)), ["dimension"]),
        "quantile_bins": lead_bias,
        "lead_bias_bins": lead_bias_bins,
        "lead_bias_medians": lambda s, d: lead_bias_bins(s, d).drop("low", "high"),
        # annotations
        "dedupe_latest": lambda s, d: A.latest(log(s, d)).select("annotator_id", "hesum_id", "task", "pos"),
        "annotator_counts": lambda s, d: log(s, d).groupBy("annotator_id").agg(F.count("*").alias("n"), F.count_if(F.col("task") == "rubric").alias("n_rubric")),
        "pairwise_rate": lambda s, d: A.pairwise_rate(A.outcomes(log(s, d))),
        "pairwise_by_annotator": lambda s, d: A.pairwise_rate(A.outcomes(log(s, d)), ["annotator_id"]),
        "pairwise_agreement": lambda s, d: A.outcome_agreement(*outcome_tables(s, d)),
        "decision_rule": decision_rule,
        "completion_check": completion_check,
        # samples, splits
        "numeric_id_order": lambda s, d: records(s, d).select("id", X.numeric_order("id")[0].alias("kind"), X.numeric_order("id")[1].alias("order_key")),
        "next_batch": lambda s, d: P.next_batch(records(s, d).select("id"), replacements(s, d)),
        "pilot_sample": pilot_sample,
        "stratified_sample": lambda s, d: P.sample(L.in_strata(rows(s, d)).select("hesum_id", "stratum").distinct(), "hesum_id", 75, by=["stratum"]),
        "seeded_sample": lambda s, d: P.sample(records(s, d).select("id"), "id", 120, P.TEST_SUBSET_SEED),
        "slot_randomised": lambda s, d: records(s, d).select("id", P.randomised_slot("id").alias("curated_is_a")),
        "split_counts": split_counts,
        "split_leakage": lambda s, d: Q.check_splits(t(s, d, "curated_records")),
        "held_out_anti": lambda s, d: P.without(records(s, d).select("id"), t(s, d, "curated_records").where("split IN ('val', 'test')").select(F.col("hesum_id").alias("id")), "id"),
        "training_pool": training_pool,
        "dedupe_text": lambda s, d: P.first_of_text(t(s, d, "records").select("pos", "text")).select("pos"),
        "pair_by_text": pair_arms,
        "training_pool_steps": lambda s, d: P.pool_steps(records(s, d).where("text IS NOT NULL").withColumnRenamed("id", "hesum_id"), t(s, d, "curated_records").where("split IN ('val', 'test')").select("hesum_id"), 500),
        "limit_sample": lambda s, d: P.limited(t(s, d, "curated_records").where("split = 'train' AND hesum_id IS NOT NULL").select("hesum_id").distinct(), "hesum_id", 60),
        "first_validation_rows": lambda s, d: P.first_rows(t(s, d, "curated_records").where("split = 'val' AND hesum_id IS NOT NULL").select("hesum_id").distinct(), "hesum_id"),
        # whole programs
        "rebuild_counts": rebuild_counts,
        "training_check": lambda s, d: R.training_check(R.training_rows(t(s, d, "curated_records"))),
        "pilot_report": pilot_report,
        "human_validation": human_validation,
        "experiment_report": lambda s, d: R.experiment_report(arms(s, d), A.outcomes(log(s, d))),
        "generation_resume": generation_resume,
        "tail_ids": lambda s, d: B.tail_ids(records(s, d).select("id", "text")),
        # replies, validation, ingest
        "judge_reply_parse": judge_reply_parse,
        "winner_reply_parse": winner_reply_parse,
        "batch_parse": batch_parse,
        "judged_records": judged_records,
        "final_check": lambda s, d: Q.check_final(L.final_dataset(records(s, d), labels(s, d), replacements(s, d))),
        "rubric_check": lambda s, d: Q.check_rubric(log(s, d).where("task = 'rubric'")),
        "loaded_predictions": lambda s, d: I.load_predictions(t(s, d, "predictions_curated")).groupBy("model", "variant").agg(F.count("*").alias("n")),
        "resume_choice": resume_choice,
        "incremental_ingest": incremental_ingest,
        "step_times": lambda s, d: Q.step_times(t(s, d, "annotations").select(F.col("pos").alias("step"), F.col("scores.cleanliness").cast("double").alias("seconds")), total_steps=3600),
        "windowed_counts": lambda s, d: M.windowed_counts(t(s, d, "events"), "ts", "1 day", "1 hour", ["event_type"]),
    }
