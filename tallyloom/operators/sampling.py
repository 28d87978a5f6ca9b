"""Deterministic samples and exact-size splits by md5 order, arm pairing, deduplication."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import text as X

#: Seeds of the samples.
SEED, TEST_SUBSET_SEED = 42, 1234


def mark(key: str, seed: int | str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def hash_rank(df: DataFrame, key: str, seed: int | str = SEED, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with each row's place (from 1) in md5 order, per group ``by``. Groups are ranked in 256 parts by the leading
    digits of the hash, so no task holds a whole group."""
    by = by or []
    marked = df.withColumn("_h", mark(key, seed)).withColumn("_s", F.substring("_h", 1, 2))
    counts = marked.groupBy(*by, "_s").agg(F.count("*").alias("_c"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    before = counts.select(*by, "_s", F.coalesce(F.sum("_c").over(w.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = marked.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_s").orderBy("_h", key)))
    return inside.join(before, [*by, "_s"]).withColumn(name, F.col("_r") + F.col("_b")).drop("_h", "_s", "_r", "_b")


def sample(df: DataFrame, key: str, n: int, seed: int | str = SEED, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """``n`` rows (per group) without replacement. ``strict`` counts first and refuses a pool of fewer rows."""
    if strict:
        sizes = df.groupBy(*(by or [])).agg(F.count("*").alias("c")).agg(F.min("c")).first()[0] or 0
        if sizes < n:
            raise ValueError(f"{n} of {sizes} records")
    return hash_rank(df, key, seed, by, "_rank").where(F.col("_rank") <= n).drop("_rank")


def limited(df: DataFrame, key: str, n: int = 120, seed: int | str = SEED) -> DataFrame:
    """All rows of a table of ``n``, a sample of exactly ``n`` of a larger one; fewer are an error."""
    return sample(df, key, n, seed, strict=True)


def first_rows(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The first ``n`` rows in order; the limit is the feature."""
    return df.orderBy(order).limit(n)


def parity_positions(total: int, n: int, seed: int = SEED) -> list[int]:
    """The positions that Python's generator draws from a list of ``total`` in lexical id order."""
    if n > total:
        raise ValueError(f"{n} of {total} records")
    return random.Random(seed).sample(range(total), n)


def parity_slots(total: int, seed: int = SEED) -> list[bool]:
    """The slot choices of Python's generator, in order."""
    rng = random.Random(seed)
    return [rng.random() < 0.5 for _ in range(total)]


def randomised_slot(key: str, seed: int | str = SEED) -> Column:
    """True for about half of the keys: the low bit of the key's mark."""
    return F.conv(F.substring(mark(key, seed), 32, 1), 16, 10).cast("int") % 2 == 0


def split_sizes(n: int) -> tuple[int, int, int]:
    """Train, val, test of an 80/10/10 split."""
    held = -(-n // 5)
    test = -(-held // 2)
    return n - held, held - test, test


def split(df: DataFrame, key: str, seed: int | str = SEED) -> DataFrame:
    """``df`` with ``split`` train, val or test of exact sizes."""
    ranked = hash_rank(df, key, seed, name="_rank")
    total = df.agg(F.count("*").alias("_n"))
    held = F.ceil(F.col("_n") / 5)
    test = F.ceil(held / 2)
    kind = F.when(F.col("_rank") <= F.col("_n") - held, "train").when(F.col("_rank") <= F.col("_n") - test, "val").otherwise("test")
    return ranked.crossJoin(F.broadcast(total)).withColumn("split", kind).drop("_rank", "_n")


def next_batch(records: DataFrame, done: DataFrame, n: int = 1000, key: str = "id") -> DataFrame:
    """The first ``n`` unprocessed records in numeric-aware order; a limit is the feature here."""
    left = records.join(done.select(F.col(key).alias("_d")).distinct(), F.col(key) == F.col("_d"), "left_anti")
    return left.orderBy(*X.numeric_order(key)).limit(n)


def without(records: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Records whose key isn't held out."""
    return records.join(held_out.select(F.col(key).alias("_h")).distinct(), F.col(key) == F.col("_h"), "left_anti")


def first_of_text(df: DataFrame, text: str = "text", order: str = "pos") -> DataFrame:
    """The first row of each exact text; the shuffle carries a digest beside the text. A null text is a text."""
    rest = [c for c in df.columns if c != text]
    one = df.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("\0")), 256).alias("_d"), F.col(text)).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return one.select(*(F.col(text) if c == text else F.col(f"_r.{c}").alias(c) for c in df.columns))


def pool_steps(records: DataFrame, held_out: DataFrame, n: int, key: str = "hesum_id", order: str = "pos", seed: int = SEED) -> DataFrame:
    """(step, n_rows) of training_pool: loaded, not held out, distinct texts, sampled."""
    free = without(records, held_out, key)
    steps = {"loaded": records, "not held out": free, "distinct texts": first_of_text(free, order=order), "sampled": training_pool(records, held_out, n, key, order, seed)}
    return reduce(DataFrame.unionByName, (df.agg(F.lit(k).alias("step"), F.count("*").alias("n_rows")) for k, df in steps.items()))


def training_pool(records: DataFrame, held_out: DataFrame, n: int, key: str = "hesum_id", order: str = "pos", seed: int = SEED) -> DataFrame:
    """The leakage-safe pool: held-out ids out, exact texts once, ``n`` sampled."""
    return sample(first_of_text(without(records, held_out, key), order=order), key, n, seed)


def pair_by_text(a: DataFrame, b: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """Arms joined on the whole text: (text, columns_a, columns_b, n_a, n_b); a side's missing text has null columns and n 0.

    Each text is reduced to one row per side before the join, and joined on a digest and the text.
    """

    def side(df: DataFrame, x: str) -> DataFrame:
        digest = F.sha2(F.coalesce(F.col(text), F.lit("\0")), 256)
        one = df.groupBy(digest.alias("_d"), F.col(text).alias("_t")).agg(F.count("*").alias("n"), F.min(F.struct(*columns)).alias("r"))
        return one.select(F.col("_d").alias("_d" + x), F.col("_t").alias("_t" + x), *(F.col(f"r.{c}").alias(f"{c}_{x}") for c in columns), F.col("n").alias("n_" + x))

    joined = side(a, "a").join(side(b, "b"), (F.col("_da") == F.col("_db")) & F.col("_ta").eqNullSafe(F.col("_tb")), "full_outer")
    return joined.select(F.coalesce("_ta", "_tb").alias(text), *(f"{c}_{x}" for c in columns for x in "ab"), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
