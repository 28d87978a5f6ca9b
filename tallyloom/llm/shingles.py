"""Texts as sets of word runs, one row per row, kept in the shared folder for the joins that read them more than once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.wordform import WordHasher, digest, runs, words
from tallyloom.operators.joins import by_ids
from tallyloom.session import keep, ship


def shingle_table(df: DataFrame, text: str, keys: list[str], width: int, min_words: int, tag: str, first: str | None = None) -> DataFrame:
    """``keys``, ``h`` (64-bit id of the word sequence), ``n`` (distinct runs of ``width`` words) and ``tri`` (their 32-bit
    hashes, sorted), written to the shared folder. Rows with fewer than ``min_words`` words or no run are left out; a
    64-bit id repeats by chance for some few of 10^10 texts, which would only join two classes of copies.

    With ``first``, one of ``keys``, a text that its partition has seen already with this key gets a null ``tri``.
    """
    spark = ship(df.sparkSession)
    picked = df.select(*keys, F.col(text).alias("_text"))
    schema = picked.drop("_text").schema.add("h", T.LongType()).add("n", T.IntegerType()).add("tri", T.ArrayType(T.IntegerType()))
    least = max(min_words, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            at, hs, sets = [], [], []
            kinds = batch.column(keys.index(first)).to_pylist() if first else None
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                found = words(t)
                if len(found) < least:
                    continue
                hashes = hasher(found)
                at.append(i)
                hs.append(digest(hashes))
                kind = (hs[-1], kinds[i]) if first else None
                if kind in seen:
                    sets.append(None)
                    continue
                if first:
                    seen.add(kind)
                sets.append(runs(hashes, width))
            idx = pa.array(at, pa.int64())
            cols = [batch.column(i).take(idx) for i in range(batch.num_columns - 1)]
            n = [len(s) if s is not None else None for s in sets]
            cols += [pa.array(hs, pa.int64()), pa.array(n, pa.int32()), pa.array(sets, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return keep(picked.mapInArrow(run, schema), tag)


def one_per_text(table: DataFrame, key: str, *also: str) -> DataFrame:
    """(h, also, n, tri): one row per distinct word sequence and ``also``; only ids are shuffled to find the later copies."""
    holders = table.where("tri IS NOT NULL")
    least = holders.groupBy("h", *also).agg(F.min(key).alias("_least"), F.count("*").alias("_c")).where("_c > 1")
    later = holders.select("h", *also, key).join(least, ["h", *also]).where(F.col(key) != F.col("_least")).select(key)
    return by_ids(holders, later, key, "left_anti").select("h", *also, "n", "tri")


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    off = column.offsets.to_numpy()
    return column.values.to_numpy()[off[0] : off[-1]], off - off[0]
