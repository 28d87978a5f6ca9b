"""Repeated tails of texts: detection by the deepest supported suffix, and trimming.

A text's tail is its longest suffix of at least ``size`` words that ``support`` texts share; tails that fewer than
``support`` texts have as their own are dropped. Suffixes are hashed cumulatively from the end, so a text yields as many
rows as words, and only texts whose last words are frequent yield any. Counts are pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import script_words, spans_of
from tallyloom.session import keep, ship

TAIL_SIZE, SUPPORT = 5, 5


def _suffix_rows(df: DataFrame, size: int) -> DataFrame:
    """(id, length, h): a hash of each suffix of ``size`` words or more of (id, ws)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, hs = [], [], []
            for i, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = xxhash.xxh3_64()
                for n, w in enumerate(reversed(ws), 1):
                    h.update(w)
                    h.update(" ")
                    if n >= size:
                        ids.append(i)
                        lengths.append(n)
                        hs.append(h.intdigest() - 2**63)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lengths, pa.int32()), pa.array(hs, pa.int64())], names=["id", "length", "h"])

    return df.mapInArrow(run, "id string, length int, h bigint")


def tail_members(records: DataFrame, size: int = TAIL_SIZE, support: int = SUPPORT) -> DataFrame:
    """(id, tail, length): the repeated tail of each record that has one. ``records`` (id, text) has one row per id."""
    ship(records.sparkSession)
    words = records.select("id", script_words("text").alias("ws")).where(F.size("ws") >= size)
    seeded = words.withColumn("seed", F.array_join(F.slice("ws", -size, size), " "))
    seeds = seeded.groupBy("seed").agg(F.count("*").alias("c")).where(F.col("c") >= support).select("seed")
    # few texts survive; they are kept, evenly spread, so the words of all texts aren't made again
    survivors = keep(seeded.join(seeds, "seed", "left_semi").select("id", "ws").repartition("id"), "tails")
    rows = _suffix_rows(survivors, size)
    supported = rows.groupBy("h", "length").agg(F.count("*").alias("c")).where(F.col("c") >= support).select("h", "length")
    deepest = rows.join(supported, ["h", "length"]).groupBy("id").agg(F.max(F.struct("length", "h")).alias("d")).select("id", "d.length", "d.h")
    kept = deepest.groupBy("h", "length").agg(F.count("*").alias("c")).where(F.col("c") >= support).select("h", "length")
    mine = deepest.join(kept, ["h", "length"], "left_semi")
    return mine.join(survivors, "id").select("id", F.array_join(F.expr("slice(ws, -length, length)"), " ").alias("tail"), "length")


def tail_candidates(records: DataFrame, size: int = TAIL_SIZE, support: int = SUPPORT) -> DataFrame:
    """(tail, length, n_records), most frequent and longest first."""
    found = tail_members(records, size, support).groupBy("tail", "length").agg(F.count("*").alias("n_records"))
    return found.orderBy(F.desc("n_records"), F.desc("length"), "tail")


def tail_ids(records: DataFrame, size: int = TAIL_SIZE, support: int = SUPPORT) -> DataFrame:
    """(tail, length, id): the records of each candidate, a row each, as a tail may be that of any number of records."""
    return tail_members(records, size, support).select("tail", "length", "id")


def unmatched(records: DataFrame, trimmed: DataFrame, size: int = TAIL_SIZE, support: int = SUPPORT) -> DataFrame:
    """(id): records with a candidate tail that trimming didn't match."""
    left = trimmed.where("NOT tail_boilerplate_removed").select(F.col("id").alias("_i"))
    return tail_members(records, size, support).join(left, F.col("id") == F.col("_i"), "left_semi").select("id")


def trim_text(text: str, tail: list[str]) -> tuple[str, bool]:
    """The text before its tail, and whether the tail matched. A tail's first words that are followed by a gap with
    metadata stay with the text."""
    words, spans = spans_of(text)
    if len(words) < len(tail) or words[len(words) - len(tail) :] != tail:
        return text, False
    at = len(words) - len(tail)
    while at + 1 < len(words) and _metadata(text[spans[at][1] : spans[at + 1][0]]):
        at += 1
    return text[: spans[at][0]].rstrip(), True


def _metadata(gap: str) -> bool:
    latin = any(c.isascii() and c.isalnum() for c in gap)
    return latin and not set(gap).isdisjoint(".!?;:)]}")


def trim_tails(records: DataFrame, size: int = TAIL_SIZE, support: int = SUPPORT) -> DataFrame:
    """``records`` with trimmed text and tail_boilerplate_removed. Records without a tail pass through untouched."""
    tails = tail_members(records, size, support).select("id", "tail")
    schema = T.StructType([*records.schema.fields, T.StructField("tail_boilerplate_removed", T.BooleanType())])
    text = records.columns.index("text")
    joined = records.join(tails, "id", "left").select(*records.columns, "tail")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [trim_text(t, tail.split(" ")) if t is not None and tail is not None else (t, False) for t, tail in zip(batch.column(text).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            cols[text] = pa.array([d[0] for d in done], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([d[1] for d in done], pa.bool_())], names=schema.names)

    return joined.mapInArrow(run, schema)
