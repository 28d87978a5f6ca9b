"""Ledger, tails, statistics, agreement, samples and validation against small independent models."""

import random
from pathlib import Path

import numpy as np
import pytest

from tallyloom.operators import agreement as A
from tallyloom.operators import boilerplate as B
from tallyloom.operators import ledger as L
from tallyloom.operators import quality as Q
from tallyloom.operators import sampling as P
from tallyloom.operators import statistics as S

TAIL = "לכתבה המלאה לחצו כאן עכשיו"


@pytest.mark.parametrize(
    "text, after, hit",
    [
        (f"גוף הכתבה. {TAIL}", "גוף הכתבה.", True),
        ("גוף הכתבה לכתבה 12. המלאה לחצו כאן עכשיו!", "גוף הכתבה לכתבה 12.", True),
        ("גוף הכתבה לכתבה המלאה לחצו כאן", "גוף הכתבה לכתבה המלאה לחצו כאן", False),
    ],
)
def test_trim(text, after, hit):
    assert B.trim_text(text, TAIL.split()) == (after, hit)


def deepest(texts: dict[str, list[str]], size=5, support=5):
    """Each text's longest suffix that enough texts share, dropped where too few have it as their own."""
    own = {}
    for k, ws in texts.items():
        for n in range(len(ws), size - 1, -1):
            if sum(o[-n:] == ws[-n:] for o in texts.values() if len(o) >= n) >= support:
                own[k] = tuple(ws[-n:])
                break
    return {k: v for k, v in own.items() if sum(x == v for x in own.values()) >= support}


def test_tails_random(spark):
    rng = random.Random(3)
    letters = "אבג"
    texts = {}
    for i in range(120):
        base = [rng.choice(letters) for _ in range(rng.randint(0, 4))]
        texts[str(i)] = base + list("אבגאב" if rng.random() < 0.6 else "גגבבא")[: rng.choice((5, 5, 4))]
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "id string, text string")
    got = {r.id: tuple(r.tail.split()) for r in B.tail_members(df).collect()}
    assert got == deepest(texts)
    assert sum(r.n_records for r in B.tail_candidates(df).collect()) == len(got)


def test_trim_table(spark):
    rows = [(str(i), f"מלה{i} {'אבגד'[i % 4]} {TAIL}", i) for i in range(6)] + [("x", None, 9), ("y", "", 10)]
    out = B.trim_tails(spark.createDataFrame(rows, "id string, text string, pos int")).collect()
    assert {r.id for r in out if r.tail_boilerplate_removed} == {str(i) for i in range(6)}
    assert {r.id: r.text for r in out}["x"] is None


def ledger_rows(spark):
    records = spark.createDataFrame([("1", "א ב", "א | ב | ג", True), ("2", "א ב", "א ב", False), ("3", None, None, False)], "id string, text string, headline string, tail_boilerplate_removed boolean")
    labels = spark.createDataFrame([("1", "usable"), ("2", "usable")], "id string, filter_label string")
    repl = spark.createDataFrame([("1", "א ב ג"), ("2", None)], "id string, replacement_headline string")
    return records, labels, repl


def test_ledger(spark):
    rows = {r.hesum_id: r for r in L.ledger(*ledger_rows(spark)).collect()}
    assert (rows["1"].headline_action, rows["1"].headline_edit_type, rows["1"].multi_pipe) == ("rewritten", "pipes_removed", True)
    assert (rows["2"].headline_action, rows["2"].headline_edit_type) == ("kept", None)
    assert (rows["3"].headline_action, rows["3"].reached_model_curation, rows["3"].n_pipes) == (None, False, 0)
    df = L.ledger(*ledger_rows(spark))
    assert {r.stratum: r.n for r in L.strata_table(df).collect()} == {"S0": 1, "S2": 1, "S3": 0, "S4": 1, "S5": 0}
    final = L.final_dataset(*ledger_rows(spark))
    assert {r.hesum_id: r.headline for r in final.collect()} == {"1": "א ב ג", "2": "א ב"}
    check = Q.check_final(final.select("hesum_id", "text", "headline")).first()
    assert (check.exact_columns, check.all_strings, check.n_rows, check.n_repeated_keys, check.n_nulls) == (True, True, 2, 0, 0)


def test_missing_filter_value_fails(spark):
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    keep = spark.createDataFrame([("1", True)], "id string, keep boolean")
    with pytest.raises(Exception, match="no filter value"):
        L.keep_all(ids, [keep]).collect()


def test_budget_is_inclusive(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(3990, 9), (3990, 10), (3990, 11)], "a int, b int")
    assert [r.k for r in df.select(L.within_budget(F.col("a"), F.col("b")).alias("k")).collect()] == [True, True, False]


def counts(*values):
    return np.bincount(values, minlength=6)[1:].astype(float)


def test_statistics_golden(spark):
    assert S.delta_of(counts(1, 2, 3), counts(3, 4, 5)) == pytest.approx(-8 / 9)
    assert S.delta_of(counts(5, 5, 4), counts(1, 5, 3)) == pytest.approx(5 / 9)
    assert S.delta_of(counts(), counts(1)) == 0
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(74, 115), (0, 0)], "k int, n int")
    low, high = S.wilson(F.col("k"), F.col("n"))
    a, b = df.select(F.round(low, 2).alias("l"), F.round(high, 2).alias("h")).collect()
    assert (a.l, a.h, b.l, b.h) == (55.26, 72.51, 0.0, 0.0)
    pairs = spark.createDataFrame([(0, a, b) for a, b in zip([1, 1, 5, 5, 4], [1, 5, 5, 4, 4])], "g int, a int, b int")
    assert S.kappa(pairs, ["g"]).first().kappa == 0.286
    assert S.kappa(spark.createDataFrame([(0, 3, 3), (0, 3, 3)], "g int, a int, b int"), ["g"]).first().kappa is None


def test_intervals_bracket():
    a, b = counts(*[1, 2, 3, 4, 5, 5, 5]), counts(*[1, 1, 2, 2, 3])
    low, high = S.bootstrap_delta(a, b)
    assert low <= S.delta_of(a, b) <= high
    values = np.array([1, 2, 3, 5, 8, 13.0])
    low, high = S.bootstrap_median(values)
    assert low <= 4.0 <= high
    low2, high2 = S.bootstrap_median_counts(values, np.ones(6))
    assert abs(low2 - low) <= 1.5 and abs(high2 - high) <= 3
    assert S.bootstrap_median(np.array([])) == (0.0, 0.0)


@pytest.mark.parametrize("n", [5, 16, 37, 100])
def test_bins_like_array_split(spark, n):
    df = spark.createDataFrame([(i, float(i * 7 % 11), 1.0) for i in range(n)], "id int, x double, y double")
    got = sorted((r.bin, r.n) for r in S.quantile_bins(df, "x", "y", "id").collect())
    assert [k for _, k in got] == [len(p) for p in np.array_split(np.arange(n), 16) if len(p)]


def test_bin_medians(spark):
    rng = np.random.default_rng(3)
    data = [(g, i, float(v), float(w)) for g, n in (("a", 37), ("b", 200)) for i, (v, w) in enumerate(zip(rng.permutation(n), rng.choice([1, 2, 5], n, p=[0.5, 0.1, 0.4])))]
    df = spark.createDataFrame([*data, ("a", 500, 1.0, None)], "g string, id int, x double, y double")
    got = {(r.g, r.bin): r for r in S.bin_medians(df, "x", "y", "id", ["g"]).collect()}
    assert len(got) == 32
    for g in "ab":
        part = sorted((x, y) for k, _, x, y in data if k == g)
        for b, at in enumerate(np.array_split(np.arange(len(part)), 16), 1):
            xs, ys, r = [part[i][0] for i in at], [part[i][1] for i in at], got[g, b]
            assert (r.n, r.x_median, r.y_median) == (len(at), np.median(xs), np.median(ys))
            assert min(ys) <= r.low <= r.y_median <= r.high <= max(ys)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_lead_bias_covers_all_series(spark):
    from tallyloom.plans import queries

    got = queries.queries()["lead_bias_bins"](spark, "/root/testdata/sf0.001")
    assert {r.series for r in got.select("series").distinct().collect()} == {"faithfulness", "single_focus", "informativeness", "cleanliness", "headline_lead_overlap"}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_interval_queries(spark):
    from tallyloom.plans import queries

    q, d = queries.queries(), "/root/testdata/sf0.001"
    medians = {(r.stratum, r.dimension): (r.n, r.median) for r in q["median_by_stratum"](spark, d).collect()}
    got = q["median_intervals"](spark, d).collect()
    assert {(r.stratum, r.dimension): (r.n, r.median) for r in got} == medians and len(got) == len(medians)
    assert all(r.low <= r.median <= r.high for r in got)
    rows = q["rubric_paired_intervals"](spark, d).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.low <= r.cliffs_delta_unpaired <= r.high and r.ci_excludes_0 == (r.low > 0 or r.high < 0)


def test_median_and_distribution(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 4, 5)] + [("b", 3), ("b", None)], "g string, score int")
    assert {r.g: (r.n, r.median) for r in S.medians(df, ["g"]).collect()} == {"a": (4, 3.0), "b": (1, 3.0)}
    d = {(r.g, r.level): r.n for r in S.distribution(df, ["g"]).collect()}
    assert d["a", 3] == 0 and d["b", 3] == 1 and len(d) == 10
    assert {r.g: r.is_degenerate for r in S.degenerate(df, ["g"]).collect()} == {"a": False, "b": True}


def annotations(spark, rows):
    ddl = "pos bigint, annotator_id string, hesum_id string, task string, submitted_at string, scores struct<faithfulness:int,single_focus:int,informativeness:int,cleanliness:int>, winner string, slot_map map<string,string>"
    return spark.createDataFrame(rows, ddl)


def test_log(spark):
    slots = {"a": "curated", "b": "original"}
    log = annotations(
        spark,
        [
            (1, "x", "1", "rubric", "2024-01-02", (1, 2, 3, 4), None, None),
            (2, "x", "1", "rubric", "2024-01-02", (5, 2, 3, None), None, None),
            (3, "x", "1", "rubric", None, (2, 2, 2, 2), None, None),
            (4, "y", "1", "rubric", "2024", (5, 9, 3, 4), None, None),
            (5, "x", "2", "pairwise", "2024", None, " A ", slots),
            (6, "x", "3", "pairwise", "2024", None, "b", slots),
            (7, "x", "4", "pairwise", "2024", None, "tie", slots),
            (8, "x", "5", "pairwise", "2024", None, "both", slots),
            (9, "x", "6", "pairwise", "2024", None, "a", None),
        ],
    )
    assert {(r.annotator_id, r.hesum_id): r.pos for r in A.latest(log).collect()}["x", "1"] == 2
    scores = {(r.annotator_id, r.dimension): r.score for r in A.long_scores(log).collect()}
    assert scores["x", "faithfulness"] == 5 and ("x", "cleanliness") not in scores and ("y", "single_focus") not in scores
    assert {r.pos: r.outcome for r in A.outcomes(log).collect()} == {5: "curated", 6: "original", 7: "tie"}
    rate = A.pairwise_rate(A.outcomes(log)).first()
    assert (rate.n, rate.curated_pct, rate.non_tie_curated_pct) == (3, 33.3, 50.0)
    assert A.pairwise_rate(A.outcomes(log.limit(0))).first().non_tie_curated_pct is None
    assert A.outcome_agreement(A.outcomes(log), A.outcomes(log).limit(0)).first().insufficient


def test_worklist_and_pool(spark):
    from tallyloom.schemas import WORKLIST

    lists = spark.createDataFrame([("disjoint", ["x"], [("1", "x", ["rubric", "pairwise"]), ("2", "y", ["rubric"])])], WORKLIST)
    tasks = A.expand_tasks(lists)
    assert tasks.count() == 3 and A.expand_tasks(lists, "y").count() == 1
    log = annotations(spark, [(1, "x", "1", "rubric", None, None, None, None)])
    done = {r.annotator_id: (r.expected_tasks, r.missing_tasks, r.complete) for r in A.completion(tasks, log).collect()}
    assert done == {"x": (2, 1, False), "y": (1, 1, False)}
    a = spark.createDataFrame([("1", "p"), ("2", "p")], "hesum_id string, scores string")
    b = spark.createDataFrame([("1", "q")], "hesum_id string, scores string")
    assert {r.hesum_id: r.scores for r in A.pool([a, b]).collect()} == {"1": "q", "2": "p"}


def test_samples(spark):
    assert P.split_sizes(5854) == (4683, 585, 586)
    df = spark.range(1000).selectExpr("cast(id as string) id", "cast(id % 3 as string) g")
    sizes = {r.split: r["count"] for r in P.split(df, "id").groupBy("split").count().collect()}
    assert sizes == dict(zip(("train", "val", "test"), P.split_sizes(1000)))
    picked = P.sample(df, "id", 7, by=["g"])
    assert picked.count() == 21 and sorted(map(tuple, picked.collect())) == sorted(map(tuple, P.sample(df, "id", 7, by=["g"]).collect()))
    ranks = sorted(r.rank for r in P.hash_rank(df, "id").collect())
    assert ranks == list(range(1, 1001))
    assert P.parity_positions(100, 5) == random.Random(42).sample(range(100), 5)
    with pytest.raises(ValueError):
        P.parity_positions(3, 5)
    assert len(P.parity_slots(9)) == 9
    done = spark.createDataFrame([("0",), ("3",)], "id string")
    assert [r.id for r in P.next_batch(df.select("id"), done, 3).collect()] == ["1", "2", "4"]


def test_text_pairs(spark):
    a = spark.createDataFrame([("t", "1"), ("t", "2"), ("u", "3"), (None, "4")], "text string, prediction string")
    b = spark.createDataFrame([("t", "5"), ("v", "6"), (None, "7")], "text string, prediction string")
    got = {r.text: (r.prediction_a, r.prediction_b, r.n_a, r.n_b) for r in P.pair_by_text(a, b, ["prediction"]).collect()}
    assert got == {"t": ("1", "5", 2, 1), "u": ("3", None, 1, 0), "v": (None, "6", 0, 1), None: ("4", "7", 1, 1)}
    df = spark.createDataFrame([(2, "t"), (1, "t"), (3, None), (4, None)], "pos int, text string")
    assert sorted(r.pos for r in P.first_of_text(df).collect()) == [1, 3]


def test_duplicate_ids(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("a", 3), ("b", 2)], "id string, pos int")
    assert [tuple(r) for r in L.duplicate_ids(df, "id", "pos").collect()] == [("a", 3, 3)]


@pytest.mark.parametrize(
    "raw, want",
    [
        ('x {"faithfulness":{"score":4,"justification":"a"}} y', {"faithfulness": 4}),
        ('{"faithfulness":{"score":4.0},"cleanliness":{"score":"x"},"single_focus":{"score":9}}', {}),
        ('{"faithfulness":{"score":true}}', {}),
        ("{bad", {}),
        ("none", {}),
        ('{"a":1} {"b":2}', {}),
        (None, None),
    ],
)
def test_rubric_reply(spark, raw, want):
    r = spark.createDataFrame([(raw,)], "raw string").select(Q.parse_rubric("raw").alias("m")).first()
    assert (r.m or {}) == (want or {})


def test_winner_and_batch(spark):
    df = spark.createDataFrame([('{"winner": " Tie "}',), ('{"winner": "c"}',), ("x",)], "raw string")
    assert [r.w for r in df.select(Q.parse_winner("raw").alias("w")).collect()] == ["tie", None, None]
    ok = '{"custom_id":"c1","response":{"status_code":200,"body":{"status":"completed","output":[{"content":[{"text":"{\\"id\\":\\"7\\"}"}]}]}}}'
    lines = [ok, ok.replace("200", "500"), ok.replace('"completed"', '"incomplete"'), ok.replace('{\\"id\\":\\"7\\"}', "zz"), '{"custom_id":"c2","error":{"code":"expired"}}', "zz"]
    got = spark.createDataFrame([(x,) for x in lines], "v string").select(Q.parse_batch_line("v").alias("p")).select("p.*").collect()
    assert [r.error for r in got] == [None, "http_error", "incomplete", "unparsable", "expired", "http_error"]
    assert (got[0].id, got[3].id) == ("7", "c1")


def test_checks(spark):
    df = spark.createDataFrame([("train", "t", "s"), ("val", "t", " "), ("val", None, "s")], "split string, text string, summary string")
    got = {r.split: (r.n, r.n_blank_text, r.n_blank_summary, r.n_shared) for r in Q.check_splits(df).collect()}
    assert got == {"train": (1, 0, 0, 1), "val": (2, 1, 1, 1)}
    steps = spark.createDataFrame([(1, 9.0), (2, 9.0), (3, 1.0), (4, 3.0)], "step int, seconds double")
    r = Q.step_times(steps, total_steps=1800).first()
    assert (r.n, r.median_s, r.min_s, r.projected_hours) == (2, 2.0, 1.0, 1.0)


def test_first_per_and_ids(spark, monkeypatch):
    from tallyloom.operators import joins as N

    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, None), (None, 4, "z"), (None, 5, "w")], "id string, pos int, text string")
    want = [("a", 1, "y"), ("b", 2, None), (None, 4, "z")]
    for limit in (N.BROADCAST_IDS, 0):  # broadcast, and the other way beyond the bound
        monkeypatch.setattr(N, "BROADCAST_IDS", limit)
        assert sorted((tuple(r) for r in N.first_per(df, "id", "pos").collect()), key=lambda r: r[1]) == want
    assert N.first_per(df.limit(0), "id", "pos").count() == 0
