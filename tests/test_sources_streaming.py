"""Files, resumable ingest, retries."""

import json

import pytest

from tallyloom.operators import judge as J
from tallyloom.sources import files as I
from tallyloom.streaming import ingest as M


def line(i, status=200):
    return json.dumps({"custom_id": f"c{i}", "response": {"status_code": status, "body": {"status": "completed", "output": [{"content": [{"text": json.dumps({"id": str(i)})}]}]}}})


def test_ingest_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("\n".join([line(1), line(2), "", line(3, 500)]))
    paths = [str(tmp_path / x) for x in ("ok", "bad", "cp")]
    M.ingest(spark, str(src), *paths)
    M.ingest(spark, str(src), *paths)  # nothing new
    (src / "2.txt").write_text("\n".join([line(2), line(4)]))
    M.ingest(spark, str(src), *paths)
    assert sorted(r.id for r in spark.read.schema(M.RESULTS).parquet(paths[0]).collect()) == ["1", "2", "4"]
    assert [r.custom_id for r in spark.read.schema(M.FAILURES).parquet(paths[1]).collect()] == ["c3"]
    records = spark.createDataFrame([(x,) for x in ("1", "2", "3", "4", "10")], "id string")
    assert [r.id for r in M.remaining(spark, records, *paths[:2]).collect()] == ["10"]
    assert {r.id for r in M.remaining(spark, records, *paths[:2], retry_failed=True).collect()} == {"10", "3"}
    assert M.finalise(spark, records, *paths[:2]) is None
    assert [r.id for r in M.finalise(spark, records.where("id <> '10'"), *paths[:2]).collect()] == ["1", "2", "4"]


def test_states():
    assert [M.next_state(s) for s in (None, "in_progress", "completed", "expired")] == ["submit", "poll", "collect", "fail"]


def test_files(spark, tmp_path):
    a = tmp_path / "a.jsonl"
    a.write_text('{"hesum_id":"1","scores":{"faithfulness":{"score":3},"other":{"score":1}}}\n\n{"hesum_id":"1","scores":{"faithfulness":{"score":4}}}\n')
    got = I.read_judge_scores(spark, str(a)).collect()
    assert [tuple(r) for r in got] == [("1", "faithfulness", 4)]
    assert I.read_judge_scores(spark, str(tmp_path / "none.jsonl")).count() == 0
    both = I.read_union(spark, [str(a), str(tmp_path / "none.jsonl")], "hesum_id string")
    assert both.count() == 2 and set(both.columns) == {"hesum_id", "file_order", "pos"}
    b = tmp_path / "b.jsonl"
    b.write_text('{"x":"1"}\n[1]\nzz\n')
    assert sorted(r.line for r in I.bad_lines(spark, str(b)).collect()) == ["[1]", "zz"]
    c = tmp_path / "c.json"
    c.write_text('[{"id":"1","text":"t"},{"id":"2","text":null}]')
    assert I.read_records(spark, str(c), "id string, text string").count() == 2
    I.save_summary(str(tmp_path / "s" / "x.json"), {"א": 1})
    assert json.loads((tmp_path / "s" / "x.json").read_text()) == {"א": 1}
    assert not list((tmp_path / "s").glob("*.tmp"))


def test_positions(spark):
    parts = [spark.range(k).selectExpr(f"concat(' t{k}-', id) text", "' h ' headline") for k in (5, 3)]
    rows = I.positioned(parts).collect()
    assert sorted(int(r.id) for r in rows) == list(range(1, 9))
    assert {r.text[:2] for r in rows if int(r.id) <= 5} == {"t5"} and {r.headline for r in rows} == {"h"}


def test_splits_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "text string, split string")
    I.write_splits(df, str(tmp_path / "sp"))
    assert [r.text for r in I.read_split(spark, str(tmp_path / "sp"), "test").collect()] == ["b"]
    calls = []
    build = lambda: calls.append(1) or df
    for _ in range(2):
        assert I.cached_table(spark, str(tmp_path / "t"), build).count() == 2
    assert len(calls) == 1
    I.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_predictions(spark):
    df = spark.createDataFrame([("t", "<think>x</think> a"), ("t", "<think>x</think>"), (" ", "a"), (None, "a"), ("t", None)], "text string, prediction string")
    assert [r.prediction for r in I.load_predictions(df).collect()] == ["a"]


def test_retry():
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 4:
            raise OSError
        return "ok"

    assert J.with_retry(flaky, sleep=waits.append) == "ok" and waits == [1, 2, 4]
    with pytest.raises(OSError):
        J.with_retry(lambda: (_ for _ in ()).throw(OSError()), sleep=lambda s: None)

    def blocked():
        raise J.Blocked

    assert J.with_retry(blocked, sleep=lambda s: pytest.fail("no retry")) == ""


def test_ask(spark):
    from tallyloom.operators.quality import parse_rubric

    df = J.ask(spark.createDataFrame([(1, "abc")], "id int, prompt string"), "prompt", J.fake_scorer)
    assert df.select(parse_rubric("raw_reply").alias("m")).first().m["faithfulness"] == 4


def test_windows(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 01:00:00' ts UNION ALL SELECT timestamp'2024-01-01 23:00:00' UNION ALL SELECT timestamp'2024-01-02 00:00:00'")
    assert sorted(r.n for r in M.windowed_counts(df, "ts", "1 day", "1 hour").collect()) == [1, 2]
