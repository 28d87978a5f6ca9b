"""Resumable ingest of externally produced results, as Structured Streaming over files.

Each micro-batch routes its lines: valid results to one table, failures to another. Both are idempotent: the first result
per id wins and a failure is kept once per batch and id. The stream's checkpoint remembers which files are done, so a run
that is stopped goes on where it was. Ids that failed count as processed and are not retried unless asked.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import numeric_order
from tallyloom.operators.quality import batch_request, parse_batch_line
from tallyloom.sources.files import exists, save_summary

#: Folders of the result tables.
PARTS = 16
RESULTS = "id STRING, data STRING"
FAILURES = "batch_id STRING, id STRING, custom_id STRING, error STRING"


def _have(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def route(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, failures) of lines (value, batch_id); of an id's results the first in order, of its failures in a batch one."""
    placed = lines.where(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    parsed = placed.select("batch_id", "value", "_at", parse_batch_line("value").alias("p")).select("batch_id", "value", "_at", "p.*")
    good = parsed.where("error IS NULL AND id IS NOT NULL").groupBy("id").agg(F.min_by("data", "_at").alias("data"))
    # a failure without any id is one of its own: its line stands for the id
    key = F.coalesce("id", "custom_id", F.concat(F.lit("line "), F.md5("value")))
    bad = parsed.where("error IS NOT NULL OR id IS NULL").withColumn("id", key).groupBy("batch_id", "id")
    first = bad.agg(F.min_by(F.struct("custom_id", F.coalesce("error", F.lit("no id")).alias("error")), "_at").alias("f"))
    return good, first.select("batch_id", "id", "f.custom_id", "f.error")


def append_new(batch: DataFrame, path: str, schema: str, keys: list[str]) -> None:
    """Append the rows whose keys aren't in the table. Rows lie in folders by a hash of ``id``: only the folders that the
    batch touches are read, and of these only the keys."""
    spark = batch.sparkSession
    marked = batch.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    seen = _have(spark, path, f"{schema}, part INT")
    touched = [r[0] for r in marked.select("part").distinct().collect()]  # PARTS at most
    known = seen.where(F.col("part").isin(touched)).select(*keys).distinct()
    marked.join(known, keys, "left_anti").write.mode("append").partitionBy("part").parquet(path)


def ingest(spark: SparkSession, source: str, results: str, failures: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Take in all files of ``source`` that no run has taken in yet, then stop. A file's name, without _output or _error and
    the suffix, is the provider's batch id, so a new checkpoint doesn't take new failures for known ones."""

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good, bad = route(batch)
        append_new(good, results, RESULTS, ["id"])
        append_new(bad, failures, FAILURES, ["batch_id", "id"])
        batch.unpersist()

    lines = spark.readStream.schema("value STRING").option("maxFilesPerTrigger", files_per_batch).text(source)
    named = lines.select("value", F.regexp_extract("_metadata.file_name", r"^(.*?)(?:_(?:output|error))?(?:\.[^.]*)?$", 1).alias("batch_id"))
    named.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Provider(Protocol):
    """What submits requests and holds their results; an adapter of a remote service, or :class:`FolderProvider`."""

    def submit(self, lines: list[str]) -> str: ...

    def state(self, batch_id: str) -> str: ...

    def fetch(self, batch_id: str) -> list[str]: ...


class FolderProvider:
    """A stand-in that answers at once: ``answer`` makes a result line of a request."""

    def __init__(self, answer: Callable[[dict], dict]):
        self.answer, self.batches = answer, {}

    def submit(self, lines: list[str]) -> str:
        name = f"batch{len(self.batches)}"
        self.batches[name] = [json.dumps(self.answer(json.loads(x)), ensure_ascii=False) for x in lines]
        return name

    def state(self, batch_id: str) -> str:
        return "completed" if batch_id in self.batches else "failed"

    def fetch(self, batch_id: str) -> list[str]:
        return sorted(self.batches[batch_id], key=lambda x: json.loads(x).get("custom_id") or "")


def advance(spark: SparkSession, records: DataFrame, prompt: str, provider: Provider, folder: str, model: str, size: int = 1000, key: str = "id") -> str:
    """One step of a batch run in ``folder`` (of the driver): submit the next ``size`` records, poll, or collect. Returns
    what was done: submitted, running, collected or complete. The state is one small file, so a later run goes on."""
    state, source = Path(folder) / "state.json", Path(folder) / "in"
    paths = [str(Path(folder) / p) for p in ("results", "failures")]
    now = json.loads(state.read_text(encoding="utf-8")) if state.exists() else None
    step = next_state(provider.state(now["id"]) if now else None)
    if step == "submit":
        left = remaining(spark, records, *paths, key=key).orderBy(*numeric_order(key)).limit(size)
        lines = [r[0] for r in left.select(batch_request(key, prompt, model)).collect()]  # `size` rows
        if not lines:
            return "complete"
        save_summary(str(state), {"id": provider.submit(lines), "n": len(lines)})
        return "submitted"
    if step == "poll":
        return "running"
    if step == "fail":
        raise RuntimeError(f"batch {now['id']} failed")
    source.mkdir(parents=True, exist_ok=True)
    (source / f"{now['id']}_output.jsonl").write_text("\n".join(provider.fetch(now["id"])) + "\n", encoding="utf-8")
    ingest(spark, str(source), *paths, str(Path(folder) / "checkpoint"))
    state.unlink()
    return "collected"


def resume(df: DataFrame, key: str, path: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make`` over the rows whose key isn't in the table at ``path``, appended to it; returns the table. A run that stopped
    goes on with the rows it lacks."""
    spark = df.sparkSession
    if exists(spark, path):
        done = spark.read.parquet(path).select(F.col(key).alias("_d")).distinct()
        df = df.join(done, F.col(key) == F.col("_d"), "left_anti")
    make(df).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def remaining(spark: SparkSession, records: DataFrame, results: str, failures: str, retry_failed: bool = False, key: str = "id") -> DataFrame:
    """Records that are neither done nor failed."""
    done = _have(spark, results, RESULTS).select("id")
    if not retry_failed:
        done = done.union(_have(spark, failures, FAILURES).select("id"))
    return records.join(done.distinct().withColumnRenamed("id", "_d"), F.col(key) == F.col("_d"), "left_anti")


def finalise(spark: SparkSession, records: DataFrame, results: str, failures: str) -> DataFrame | None:
    """The results in order, or nothing while any record is unprocessed."""
    if remaining(spark, records, results, failures).limit(1).count():
        return None
    return _have(spark, results, RESULTS).orderBy(*numeric_order("id"))


def next_state(state: str | None) -> str:
    """What a run does with a batch in this state: submit, poll, collect or fail."""
    if state is None:
        return "submit"
    if state in ("validating", "in_progress", "finalizing", "cancelling"):
        return "poll"
    return "collect" if state == "completed" else "fail"


def windowed_counts(events: DataFrame, time: str, size: str, late: str, by: list[str] | None = None) -> DataFrame:
    """Counts per tumbling window with a watermark; works on a table and on a stream."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, size).alias("w"), *(by or [])).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *(by or []), "n")
