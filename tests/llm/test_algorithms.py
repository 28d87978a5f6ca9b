"""Near duplicates, cross-split joins, quotas and consensus against brute force, and their defined edge cases."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tallyloom.llm import consensus as C
from tallyloom.llm import crosssplit as CS
from tallyloom.llm import neardup as ND
from tallyloom.llm import quota as QT
from tallyloom.llm.wordform import words, words_with_spans


def grams(text, n=3):
    w = words(text)
    return frozenset(zip(*(w[i:] for i in range(n))))


def similar(a, b, at=0.5):
    return bool(a | b) and len(a & b) >= at * len(a | b)


def corpus(seed=1, families=40, length=80):
    """Families of edited copies over shared boilerplate, exact copies, and marks and punctuation as noise."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    tail = [f"t{i}" for i in range(12)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(rng.choice((1, 2, 4))):
            t = list(base)
            for _ in range(rng.randint(0, 9)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.5:
                t += tail
            texts.append(rng.choice((" ", ", ")).join(t).replace("w1", "Wְ1"))
    return texts + texts[:7]


def test_joins_beyond_the_broadcast_bound(spark):
    """The way of larger id tables, a shuffle join, has the same results."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(3, 12))], "pos bigint, text string")
    found = lambda: {tuple(r) for r in ND.near_duplicate_pairs(df, p=ND.ARTICLES).collect()}
    sides = [df.selectExpr("IF(pos % 3 = 0, 'test', 'train') AS split", "CAST(pos AS string) AS key", "text")]
    overlapping = lambda: {tuple(r) for r in CS.overlaps(*CS.cross_split(sides, CS.ARTICLES)).collect()}
    want = found(), overlapping()
    spark.conf.set("tallyloom.broadcastIds", "0")
    try:
        assert (found(), overlapping()) == want and all(want)
    finally:
        spark.conf.unset("tallyloom.broadcastIds")


def test_near_duplicates(spark):
    texts = corpus()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(900, None, None, 0), (901, "", "x", 0), (902, "w1 w2", "x", 0), (903, "w1 w2", "x", 0)]
    df = spark.createDataFrame(rows, "pos bigint, text string, h string, n int")  # names that the operator uses itself
    got = {(r.pos_a, r.pos_b) for r in ND.near_duplicate_pairs(df, p=ND.ARTICLES).collect()}
    g = {i: grams(t) for i, t in enumerate(texts)}
    want = {(a, b) for a, b in combinations(g, 2) if similar(g[a], g[b])}
    assert got == want and len(want) > 40
    groups = {r.pos: r for r in ND.near_duplicate_groups(df, p=ND.ARTICLES).collect()}
    assert len(groups) == len(rows)
    degree = Counter(x for p in want for x in p)
    assert all(groups[i].n_links == degree[i] for i in range(len(texts)))
    parent = {i: i for i in range(len(texts))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in want:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(groups[i].group == root(i) for i in range(len(texts)))
    assert groups[900].group == 900 and groups[900].n_links == 0


def test_near_duplicates_default_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f g h")], "pos bigint, text string")
    # five words and 0.8: the third has 4 runs, 3 of them shared
    assert [(r.pos_a, r.pos_b) for r in ND.near_duplicate_pairs(df).collect()] == [(1, 2)]
    assert ND.near_duplicate_pairs(df.limit(0)).count() == 0 and ND.near_duplicate_groups(df.limit(0)).count() == 0


def test_hot_copies(spark):
    """A third of the rows are one text."""
    texts = ["same " + " ".join(f"s{i}" for i in range(40))] * 60 + corpus(4, 30)[:120]
    df = spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string")
    got = ND.near_duplicate_pairs(df, p=ND.ARTICLES).where("pos_b < 60").count()
    assert got == 60 * 59 // 2


def test_cross_split(spark):
    texts = corpus(2)
    rng = random.Random(5)
    rows = [(rng.choice(("train", "train", "val", "test")), str(i), t, f"s{i % 3}", "z") for i, t in enumerate(texts)]
    rows += [("train", "0", texts[1], "s", "z"), ("val", None, texts[0], "s", "z"), (None, "q", texts[0], "s", "z"), ("test", "n", None, "s", "z"), ("test", "e", "", "s", "z"), rows[3]]
    cur = spark.createDataFrame(rows, "split string, hesum_id string, text string, source string, tri string")
    pred = spark.createDataFrame([(1, texts[0]), (2, texts[5]), (3, texts[5]), (4, None)], "pos bigint, text string")
    members, pairs = CS.cross_split(CS.sides_of(cur, pred), CS.ARTICLES)
    got = {(r.split, r.eval_key, r.train_id) for r in CS.overlaps(members, pairs).collect()}
    train = [(i, grams(t)) for s, i, t, *_ in rows if s == "train" and i and t]
    evals = [(s, i, grams(t)) for s, i, t, *_ in rows if s in ("val", "test") and i and t] + [("predictions", str(p), grams(t)) for p, t in ((1, texts[0]), (2, texts[5]), (3, texts[5]))]
    assert got == {(s, e, i) for s, e, a in evals for i, b in train if similar(a, b)} and len(got) > 20
    report = CS.split_report(cur, pred).collect()
    assert sum(r.n_exact + r.n_near for r in report) >= len(got)
    members, pairs = CS.cross_split(CS.sides_of(cur.limit(0), pred.limit(0)), CS.ARTICLES)
    assert CS.overlaps(members, pairs).count() == 0


def test_split_rates(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [("train", "1", a, "x"), ("train", "2", b, "x"), ("train", "3", c, "y"), ("val", "4", a + " more", "y"), ("val", "5", d, "y"), ("val", "5", d, "y"), ("test", "6", d, "z"), ("test", "7", b, "x"), ("test", None, b, "x")]
    cur = spark.createDataFrame(rows, "split string, hesum_id string, text string, source string")
    pred = spark.createDataFrame([(1, d), (2, b), (3, None)], "pos bigint, text string")
    got = {(r.split, r.source): (r.n_keys, r.n_overlapping, r.rate) for r in CS.split_rates(cur, pred).collect()}
    assert got == {
        ("train", "x"): (2, 2, 1.0), ("train", "y"): (1, 0, 0.0), ("val", "y"): (2, 1, 0.5), ("test", "z"): (1, 0, 0.0), ("test", "x"): (1, 1, 1.0),
        ("predictions", "z"): (1, 0, 0.0), ("predictions", "x"): (1, 1, 1.0), ("predictions", None): (1, 0, 0.0),
    }


def quota_tables(spark, rows, targets):
    return (
        spark.createDataFrame(rows, "hesum_id string, source_label string, headline_action string, multi_pipe boolean, target_pct int, w int"),
        spark.createDataFrame(targets, "target_id int, source_label string, headline_action string, multi_pipe boolean, target_pct int, min_rows int"),
    )


def test_quota(spark):
    rows = [(str(i), "a", None, False, 1, 1) for i in range(300)] + [(str(i), "b", "kept", True, 1, 1) for i in range(300, 306)] + [(str(i), None, None, None, 1, 1) for i in range(306, 1000)]
    rows += rows[:50] + [(None, "a", None, False, 1, 1)]
    targets = [(1, "a", None, False, 40, 1), (2, "b", "kept", True, 2, 5), (3, None, None, None, 50, 2), (4, "c", "kept", True, 5, 1), (5, "b", "kept", True, 20, None), (6, "d", None, None, None, -3)]
    t = quota_tables(spark, rows, targets)
    r = {x.target_id: x for x in QT.report(*t).collect()}
    assert {k: (x.need, x.available, x.can_be_met) for k, x in r.items()} == {1: (40, 300, True), 2: (5, 6, True), 3: (50, 694, True), 4: (5, 0, False), 5: (20, 6, False), 6: (0, 0, True)}
    assert (r[1].drawn, r[2].drawn, r[3].drawn) == (40, 5, 50) and r[2].repaired == 3
    drawn = QT.draw(*t).collect()
    assert len({x.hesum_id for x in drawn}) == len(drawn)
    assert {x.hesum_id for x in QT.draw(*t, seed="9").collect()} != {x.hesum_id for x in drawn}


def test_quota_empty(spark):
    rows, targets = quota_tables(spark, [("1", "a", None, False, 1, 1)], [(1, "a", None, False, 40, 1)])
    assert [(x.need, x.available, x.drawn) for x in QT.report(rows.limit(0), targets).collect()] == [(1, 0, 0)]
    assert QT.draw(rows, targets.limit(0)).count() == 0


def test_quota_is_proportional(spark):
    """Over many starts every id is drawn about as often as its probability says."""
    t = quota_tables(spark, [(str(i), "a", None, False, 1, 1) for i in range(100)], [(1, "a", None, False, 55, 0)])
    n = [QT.draw(*t, start=s).count() for s in (0, 20, 40, 60, 80, 99)]
    assert set(n) == {5, 6} or set(n) == {5} or set(n) == {6}


def simulated(seed=0, items=400):
    rng = np.random.default_rng(seed)
    good, shifted, blind = [f"g{i}" for i in range(6)], ["s0", "s1"], ["b0"]
    log, truth, pos = [], {}, 0
    for i in range(items):
        c = int(rng.choice([1, 2, 3, 4, 5], p=[0.05, 0.1, 0.25, 0.25, 0.35]))
        truth[str(i)] = c
        for a in rng.permutation(good + shifted + blind)[: int(rng.integers(3, 6))]:
            if a in blind:
                v = int(rng.integers(1, 6))
            elif rng.random() < 0.15:
                v = int(np.clip(c + rng.choice([-1, 1]), 1, 5))
            else:
                v = c if a in good else max(1, c - 1)
            pos += 1
            log.append((pos, str(a), str(i), "rubric", "2024", (v, 1, 1, 1), None, None))
    return log, truth


DDL = "pos bigint, annotator_id string, hesum_id string, task string, submitted_at string, scores struct<faithfulness:int,single_focus:int,informativeness:int,cleanliness:int>, winner string, slot_map map<string,string>, label string"


def test_consensus_beats_majority(spark):
    log, truth = simulated()
    df = spark.createDataFrame([(*r, "clash") for r in log], DDL)
    got = {r.hesum_id: r for r in C.consensus(df).collect()}
    votes = defaultdict(list)
    for r in log:
        votes[r[2]].append(r[5][0])
    majority = np.mean([Counter(sorted(v)).most_common(1)[0][0] == truth[k] for k, v in votes.items() if k in got])
    ours = np.mean([int(got[k].label) == truth[k] for k in got])
    assert ours > 0.9 and ours >= majority
    v = votes["0"]
    pairs = [a == b for a, b in combinations(v, 2)]
    assert got["0"].pair_agreement == pytest.approx(np.mean(pairs))
    rel = {r.annotator_id: r.reliability for r in C.reliability(df).collect() if r.task == "rubric"}
    assert min(rel[f"g{i}"] for i in range(6)) > 0.75 > max(rel["s0"], rel["b0"])


def test_consensus_edges(spark):
    slots, swapped = {"a": "curated", "b": "original"}, {"a": "original", "b": "curated"}
    rows = [
        (1, "x", "1", "pairwise", None, None, " A ", slots, ""), (2, "y", "1", "pairwise", "2024", None, "b", swapped, ""), (3, "z", "1", "pairwise", "2024", None, "a", slots, ""),
        (4, "x", "2", "pairwise", "2024", None, "both", slots, ""), (5, "y", "2", "pairwise", "2024", None, "a", None, ""), (6, None, "1", "rubric", "2024", (1, 1, 1, 1), None, None, ""),
        (7, "x", "3", "rubric", "2024", (9, 1, 1, 1), None, None, ""), (8, "x", "3", "rubric", "2023", (4, 1, 1, 1), None, None, ""), (9, "y", "3", "rubric", "2023", (4, 1, 1, 1), None, None, ""),
        (10, "z", "3", "rubric", "2023", (4, 1, 1, 1), None, None, ""), (11, "z", "4", "rubric", "2023", None, None, None, ""), (12, "x", None, "rubric", "2023", (4, 1, 1, 1), None, None, ""),
    ]
    df = spark.createDataFrame(rows, DDL)
    assert {(r.hesum_id, r.task): r.label for r in C.consensus(df).collect()} == {("1", "pairwise"): "curated", ("3", "rubric"): "4"}
    assert {r.label for r in C.usable_labels(df).where("hesum_id = '3' AND annotator_id = 'x'").collect()} == {"4"}
    assert C.consensus(df.limit(0)).count() == 0 and C.reliability(df.limit(0)).count() == 0


def test_words():
    assert words("Abְc‍ D-e_2 ²x") == ["abc", "d", "e", "2", "²x"]
    assert words(None) == words("") == words(" ְ ") == []
    text = "‏שָלום, İx"
    found, spans = words_with_spans(text)
    assert found[0] == "שלום" and text[spans[0][0] : spans[0][1]] == "שָלום"
    assert all(0 <= a < b <= len(text) for a, b in spans)
