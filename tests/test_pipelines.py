"""Whole programs on small tables with known results: build, training data, reports, batch runs, resumed generation."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import agreement as A
from tallyloom.operators import boilerplate as B
from tallyloom.operators import ledger as L
from tallyloom.operators import sampling as P
from tallyloom.plans import pipelines as R
from tallyloom.streaming import ingest as M

TAIL = "לכתבה המלאה לחצו כאן עכשיו"


def value(report, section, measure, who=None, dimension=None):
    rows = [r.value for r in report if (r.section, r.measure, r.who, r.dimension) == (section, measure, who, dimension)]
    assert len(rows) == 1, rows
    return rows[0]


def test_rebuild(spark):
    rows = [(str(i), f"גוף {'אבגדה'[i % 5]} הכתבה {TAIL}", "כותרת") for i in range(6)] + [("6", "גוף אחר", "א | ב | ג"), ("7", "x " * 4100, "ארוך"), ("8", None, None)]
    records = spark.createDataFrame(rows, "id string, text string, headline string")
    labels = spark.createDataFrame([("0", "usable"), ("1", "usable"), ("2", "unusable_live_blog"), ("6", None)], "id string, filter_label string")
    repl = spark.createDataFrame([("0", None), ("1", "חדשה"), ("2", "x")], "id string, replacement_headline string")
    b = R.rebuild(records, labels, repl)
    assert {(r.hesum_id, r.headline) for r in b.final.collect()} == {("0", "כותרת"), ("1", "חדשה")}
    assert all(TAIL not in r.text for r in b.final.collect())
    n = {r.step: r.n for r in b.counts(labels, repl).collect()}
    assert (n["records"], n["tails trimmed"], n["eligible"], n["labelled"], n["usable"], n["kept"], n["rewritten"], n["final"]) == (9, 6, 7, 4, 2, 1, 2, 2)
    assert R.rebuild(records.limit(0), labels, repl).final.count() == 0
    assert B.unmatched(records, b.trimmed).count() == 0 and {r.id for r in B.tail_ids(records.select("id", "text")).collect()} == {str(i) for i in range(6)}
    with pytest.raises(ValueError):
        L.usable_ids(labels.union(labels), strict=True)
    with pytest.raises(ValueError):
        L.usable_ids(labels.where("filter_label IS NULL"), strict=True)
    assert L.usable_ids(labels, strict=True).count() == 2


def test_training_check(spark):
    rows = [("train", " א ב ", "ג", 1), ("train", "", "ג", 2), ("val", "א ב", "ד", 3), ("test", "ה", None, 4), (None, "ו", "ז", 5)]
    made = R.training_rows(spark.createDataFrame(rows, "split string, text string, summary string, prompt int"))
    got = {r.split: r for r in R.training_check(made).collect()}
    assert set(got) == {"train", "val", None} and got["train"].n == 1 and got["train"].n_shared == 1 and got["val"].n_shared == 1
    assert all(r.n_prompt_lacks_text == 0 and r.n_other_completion == 0 for r in got.values())
    worse = R.training_check(made.withColumn("prompt", F.lit("x")).withColumn("completion", F.lit(None).cast("string"))).collect()
    assert all(r.n_prompt_lacks_text == r.n_other_completion == r.n for r in worse)


def test_samples_refuse_small_pools(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert P.limited(df, "k", 10).count() == 10 and P.limited(df, "k", 4).count() == 4
    for wrong in (df, df.limit(0)):
        with pytest.raises(ValueError):
            P.limited(wrong, "k", 11)
    assert [r.k for r in P.first_rows(df, "k", 3).collect()] == [0, 1, 2] and R.retest(df, "k", 60).count() == 10
    records = spark.createDataFrame([("a", "t", 1), ("b", "t", 2), ("c", "u", 3), ("d", None, 4)], "hesum_id string, text string, pos bigint")
    steps = {r.step: r.n_rows for r in P.pool_steps(records, records.where("hesum_id = 'c'").select("hesum_id"), 1).collect()}
    assert steps == {"loaded": 4, "not held out": 3, "distinct texts": 2, "sampled": 1}


LOG = "pos bigint, annotator_id string, hesum_id string, task string, submitted_at string, scores struct<faithfulness:int,single_focus:int,informativeness:int,cleanliness:int>, winner string, slot_map map<string,string>"


def test_human_validation(spark):
    one = {"a": "curated", "b": "original"}
    rows = [
        (1, "x", "1", "rubric", "t1", (5, 4, 3, 2), None, None), (2, "x", "2", "rubric", "t1", (1, 4, 3, 9), None, None), (3, "y", "1", "rubric", "t1", (4, 4, 3, 2), None, None),
        (4, "x", "1", "pairwise", "t1", None, "a", one), (5, "y", "2", "pairwise", "t1", None, " B ", one), (6, "y", "2", "pairwise", None, None, None, None),
    ]
    log = spark.createDataFrame(rows, LOG)
    tasks = spark.createDataFrame([("x", "1", "rubric"), ("x", "1", "pairwise"), ("x", "3", "rubric")], "assigned_annotator string, hesum_id string, task string")
    judge = spark.createDataFrame([("1", "faithfulness", 5), ("2", "faithfulness", 1)], "hesum_id string, dimension string, score int")
    outcomes = spark.createDataFrame([("1", "curated"), ("2", "curated")], "hesum_id string, outcome string")
    got = R.human_validation(log, tasks, judge, outcomes).collect()
    assert [value(got, "completion", m, "x") for m in ("expected", "submitted", "missing")] == [3, 2, 1]
    assert value(got, "judge and rater", "kappa", "x", "faithfulness") == 1.0 and value(got, "judge and rater", "n", "y", "faithfulness") == 1
    assert value(got, "closeness", "mean_raters", None, "faithfulness") == 2.5 and value(got, "closeness", "within_one_pct", None, "faithfulness") == 100
    assert value(got, "pairs agreed with judge", "percent_agreement", "x") == 100 and value(got, "pairs agreed with judge", "percent_agreement", "y") == 0
    assert value(got, "win rate", "non_tie_curated_pct") == 50 and not [r for r in got if r.section == "two raters"]
    both = R.human_validation(log, tasks, disjoint=False).collect()
    assert value(both, "two raters", "n", "x and y", "faithfulness") == 1 and not [r for r in both if r.section.startswith("judge")]
    assert {r.section for r in R.human_validation(log, tasks, check_only=True).collect()} == {"completion"}


def test_pilot_and_experiment(spark):
    first = spark.createDataFrame([(str(i), "cleanliness", 5) for i in range(9)] + [("9", "cleanliness", 4)], "hesum_id string, dimension string, score int")
    second = first.where("hesum_id >= '7'").withColumn("score", F.col("score"))
    got = R.pilot_report(first, second).collect()
    assert value(got, "distribution", "n", "level 5", "cleanliness") == 9 and value(got, "distribution", "n", "level 1", "cleanliness") == 0
    assert value(got, "degenerate", "is_degenerate", None, "cleanliness") == 1 and value(got, "test-retest", "kappa", None, "cleanliness") == 1.0
    pairs = spark.createDataFrame([("d", 1, 2), ("d", 3, 3)], "dimension string, raw int, curated int")
    won = spark.createDataFrame([("curated",), ("tie",)], "outcome string")
    intervals = spark.createDataFrame([("d", 0.25, -0.5, 0.75)], "dimension string, delta double, low double, high double")
    e = R.experiment_report(pairs, won, intervals).collect()
    assert value(e, "mean", "mean_score", "raw", "d") == 2.0 and value(e, "level", "n", "curated 3", "d") == 1 and value(e, "win rate", "n") == 2 and value(e, "delta", "low", None, "d") == -0.5


def test_decision(spark):
    rate = A.pairwise_rate(spark.createDataFrame([("curated",), ("original",)], "outcome string"))
    ci = spark.createDataFrame([(0.1, 0.2)], "low double, high double")
    assert A.decision(rate, ci).first().adopt and not A.decision(rate, ci.limit(0)).first().adopt
    assert not A.decision(rate, ci.withColumn("low", F.lit(-0.1))).first().adopt


def test_batch_run(spark, tmp_path):
    def answer(request):
        k = request["custom_id"]
        text = "none" if k == "3" else '{"label": "usable"}'
        body = {"status": "completed", "output": [{"content": [{"text": text}]}]}
        return {"custom_id": k, "response": {"status_code": 200, "body": body}}

    records = spark.createDataFrame([(str(i), f"p{i}") for i in (1, 2, 3, 10)], "id string, prompt string")
    provider = M.FolderProvider(answer)
    go = lambda: M.advance(spark, records, "prompt", provider, str(tmp_path), "m", size=3)
    assert [go() for _ in range(5)] == ["submitted", "collected", "submitted", "collected", "complete"]
    paths = [str(tmp_path / p) for p in ("results", "failures")]
    assert sorted(r.id for r in spark.read.parquet(paths[0]).collect()) == ["1", "10", "2"]
    assert [(r.batch_id, r.id, r.error) for r in spark.read.parquet(paths[1]).collect()] == [("batch0", "3", "unparsable")]
    provider.state = lambda name: "in_progress"
    more = records.union(spark.createDataFrame([("11", "p11")], records.schema))
    step = lambda: M.advance(spark, more, "prompt", provider, str(tmp_path), "m")
    assert [step(), step()] == ["submitted", "running"]
    provider.state = lambda name: "expired"
    with pytest.raises(RuntimeError):
        step()


def test_first_result_wins(spark):
    line = '{"custom_id": "c", "response": {"status_code": 200, "body": {"status": "completed", "output": [{"content": [{"text": "{\\"id\\": \\"1\\", \\"v\\": %d}"}]}]}}}'
    lines = spark.createDataFrame([(line % v, "b") for v in (9, 1, 5)] + [("junk", "b"), ("other junk", "b"), ("junk", "b2"), (" ", "b")], "value string, batch_id string").coalesce(1)
    good, bad = M.route(lines)
    assert [(r.id, '"v": 9' in r.data) for r in good.collect()] == [("1", True)]
    assert sorted(r.batch_id for r in bad.collect()) == ["b", "b", "b2"]  # failures without an id stay apart


def test_resume(spark, tmp_path):
    calls = []
    make = lambda df: (calls.append(df.count()), df.select("id", F.upper("id").alias("reply")))[1]
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    M.resume(df.where("id = 'a'"), "id", str(tmp_path / "out"), make)
    assert sorted(tuple(r) for r in M.resume(df, "id", str(tmp_path / "out"), make).collect()) == [("a", "A"), ("b", "B"), ("c", "C")] and calls == [1, 2]


def test_kept_tables(spark):
    from tallyloom import session
    from tallyloom.sources.files import exists

    inner = []
    outer = session.keep(lambda: (inner.append(session.keep(spark.range(3), "inner")), inner[0].selectExpr("id + 1 AS id"))[1], "outer")
    paths = [df.inputFiles()[0].rsplit("/", 1)[0] for df in (*inner, outer)]
    assert [exists(spark, p) for p in paths] == [False, True] and sorted(r.id for r in outer.collect()) == [1, 2, 3]


def test_no_shared_folder_on_a_cluster():
    from unittest.mock import MagicMock

    from tallyloom import session

    spark = MagicMock()
    spark.conf.get.return_value = spark.sparkContext.getConf().get.return_value = None
    spark.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        spark.sparkContext.master = master
        with pytest.raises(RuntimeError):
            session.shared_dir(spark)
    spark.sparkContext.master = "local[4]"
    assert session.shared_dir(spark).startswith("file://")
