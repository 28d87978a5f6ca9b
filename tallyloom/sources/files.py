"""Readers and writers. Readers take declared schemas; writers commit through Spark's protocol or a rename."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.schemas import DIMENSIONS


@dataclass(frozen=True)
class Layout:
    """Where a project's tables lie."""

    root: str

    def artifacts(self, name: str) -> str:
        return f"{self.root}/artifacts/{name}"

    def results(self, name: str) -> str:
        return f"{self.root}/results/{name}"

    def outputs(self, name: str) -> str:
        return f"{self.root}/outputs/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or object in one file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One object per line; blank lines are skipped. ``strict`` fails on a line that isn't an object."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of lines that aren't JSON objects."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = F.try_parse_json("value")
    return lines.where(parsed.isNull() | ~F.ltrim("value").startswith("{")).select("file", F.col("value").alias("line"))


def read_union(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Several JSON-lines files, missing ones skipped, with file_order and pos (order inside the file is by offset)."""
    found = [(i, p) for i, p in enumerate(paths) if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], f"{schema}, file_order INT, pos BIGINT")
    parts = [read_jsonl(spark, p, schema).withColumn("file_order", F.lit(i)).withColumn("pos", F.monotonically_increasing_id()) for i, p in found]
    return reduce(DataFrame.unionByName, parts)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines or a JSON array, by suffix."""
    return read_jsonl(spark, path, schema) if path.endswith(".jsonl") else read_json(spark, path, schema)


def positioned(splits: list[DataFrame]) -> DataFrame:
    """All splits in order, with id the 1-based place as text and both texts stripped.

    Places come from per-partition counts, so nothing is sorted in one task.
    """
    rows = reduce(DataFrame.unionByName, [s.select("text", "headline", F.lit(i).alias("_s")) for i, s in enumerate(splits)])
    rows = rows.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    from tallyloom.session import keep

    rows = keep(rows.withColumn("_p", part), "positions")
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    from pyspark.sql import Window as W

    before = sizes.select("_p", "_first", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    placed = rows.join(F.broadcast(before), "_p").withColumn("_n", F.col("_m") - F.col("_first") + F.col("_b") + 1)
    return placed.select(F.col("_n").cast("string").alias("id"), X.strip("text").alias("text"), X.strip("headline").alias("headline"))


def cached_table(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """The table at ``path``; built and written first if it isn't there."""
    if force or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    from tallyloom.schemas import WORKLIST

    lists = read_json(spark, path, WORKLIST)
    if lists.where("rows IS NULL").limit(1).count():
        raise ValueError("a worklist needs rows")
    return lists


def read_judge_scores(spark: SparkSession, path: str) -> DataFrame:
    """(hesum_id, dimension, score): the last line of an id wins; a missing file has none."""
    from tallyloom.schemas import JUDGE_SCORES

    if not exists(spark, path):
        return spark.createDataFrame([], "hesum_id string, dimension string, score int")
    rows = read_jsonl(spark, path, JUDGE_SCORES).withColumn("pos", F.monotonically_increasing_id())
    last = rows.groupBy("hesum_id").agg(F.max_by("scores", "pos").alias("scores"))
    return last.select("hesum_id", F.explode("scores").alias("dimension", "v")).where(F.col("dimension").isin(*DIMENSIONS)).select("hesum_id", "dimension", "v.score")


def read_judge_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(hesum_id, outcome) of valid lines, the last wins."""
    from tallyloom.schemas import JUDGE_OUTCOME

    rows = read_jsonl(spark, path, JUDGE_OUTCOME).withColumn("pos", F.monotonically_increasing_id())
    return rows.where(F.col("outcome").isin("curated", "original", "tie")).groupBy("hesum_id").agg(F.max_by("outcome", "pos").alias("outcome"))


def scored_only(df: DataFrame) -> DataFrame:
    """Rows whose judge call succeeded."""
    return df.where(F.coalesce(F.size("scores"), F.lit(0)) > 0)


def load_predictions(df: DataFrame) -> DataFrame:
    """Predictions without closed reasoning blocks, with text and prediction both there."""
    out = df.withColumn("prediction", X.strip_think("prediction"))
    return out.where("text IS NOT NULL AND prediction IS NOT NULL").where((X.strip("text") != "") & (F.col("prediction") != ""))


def for_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a requested id set."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; the others' folders aren't read."""
    return spark.read.parquet(path).where(F.col("split") == split)


def save_summary(path: str, data) -> None:
    """A small JSON document on the driver, written beside and renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=target.parent, suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(data, f, ensure_ascii=False, indent=2)
        os.replace(temp, target)
    except OSError:
        if not (target.exists() and target.read_text(encoding="utf-8") == json.dumps(data, ensure_ascii=False, indent=2)):
            raise  # the temporary file stays
        os.unlink(temp)
