"""Problem 5: the same or nearly the same text in an evaluation split and in the training split.

A weighted cosine join between two sides. A text is a vector of its distinct word runs, each of weight 1 / sqrt(n), so all
have norm 1 and a Jaccard similarity s means a cosine of at least 2 s / (1 + s). Terms are ordered from rare to frequent by
counts on both sides. A text is posted in inverted lists under its rarest terms only: the rest, its residual, is left out
as long as neither the norm of the residual nor its sum times the greatest weight that a partner of fitting size can have
lets the residual alone reach the threshold. Terms that the other side does not hold can't add to a dot product and are
never posted. Posted pairs are compared by a sketch of one-bit min-hashes inside the join, then by exact dot products.

The order comes from two count tables of a fixed number of buckets (8 MB each), made from partial counts per partition; a
bucket only ever counts too much, which costs candidates, never a link. Copies are one text before anything is posted.

Defined results: null and empty texts and texts under ``width`` words have no partners; repeated rows and ids in several
splits are reported once per split, key and training id; rows with a null id are left out; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shingles import flat, one_per_text, shingle_table
from tallyloom.operators.joins import by_ids
from tallyloom.session import keep


BITS = 256


@dataclass(frozen=True)
class CosineJoin:
    """Parameters; of 256 sketch bits two texts of similarity s agree on 128 (1 + s) on average (0.5: 192, deviation 6.9)."""

    width: int = 5
    similarity: float = 0.8
    buckets: int = 1 << 21
    sketch_slack: float = 4.3

    @property
    def cosine(self) -> float:
        return 2 * self.similarity / (1 + self.similarity)

    @property
    def sketch_bits(self) -> int:
        p = (1 + self.similarity) / 2
        return math.floor(BITS * p - self.sketch_slack * math.sqrt(BITS * p * (1 - p)))


#: What TESTDATA.md states for articles.
ARTICLES = CosineJoin(width=3, similarity=0.5)


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(7)) % np.uint32(buckets)


def term_counts(texts: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts per term bucket, on the training and on the evaluation side: two arrays of ``buckets`` counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            values, off = flat(batch.column(0))
            at = _bucket(values, buckets)
            train = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(off))
            n[0] += np.bincount(at[train], minlength=buckets)
            n[1] += np.bincount(at[~train], minlength=buckets)
        hit = np.flatnonzero(n.any(axis=0))
        for k in range(0, len(hit), 100_000):
            part = hit[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[0, part]), pa.array(n[1, part])], names=["b", "t", "e"])

    partial = texts.select("tri", "train").mapInArrow(run, "b bigint, t bigint, e bigint")
    count = lambda c: F.least(F.sum(c), F.lit(2**31 - 1)).cast("int").alias(c)
    total = partial.groupBy(F.col("b").cast("int").alias("b")).agg(count("t"), count("e")).toArrow()  # `buckets` rows of 12 bytes at most
    out = np.zeros((2, buckets), dtype=np.int32)
    at = total.column("b").to_numpy()
    out[0, at], out[1, at] = total.column("t").to_numpy(), total.column("e").to_numpy()
    return out[0], out[1]


def _sketch(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """256 bits of each text, each one bit of a min-hash, in four integers."""
    rng = np.random.default_rng(11)
    a = rng.integers(0, 2**32, BITS, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, BITS, dtype=np.uint32)
    x = values.view(np.uint32)
    out = np.zeros((BITS // 64, len(starts)), dtype=np.uint64)
    for i in range(BITS):
        h = x * a[i] + b[i]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        low = np.minimum.reduceat(h, starts)
        bit = ((low * np.uint32(0x85EBCA6B)) >> np.uint32(20)) & np.uint32(1)
        out[i // 64] |= bit.astype(np.uint64) << np.uint64(i % 64)
    return out.view(np.int64)


def indexed(texts: DataFrame, p: CosineJoin, counts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(train, term, h, n, s1 to s4): the indexed part of each text's vector, with its sketch."""
    cast = texts.sparkSession.sparkContext.broadcast(counts)  # of fixed size
    names = ["train", "term", "h", "n", "s1", "s2", "s3", "s4"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_t, counts_e = cast.value
        for batch in batches:
            if not batch.num_rows:
                continue
            values, off = flat(batch.column(1))
            train = batch.column(2).to_numpy(zero_copy_only=False)
            sizes = np.diff(off)
            sketch = _sketch(values, off[:-1])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = _bucket(values, p.buckets)
            t, e = counts_t[at], counts_e[at]
            meets = np.where(train[owner], e, t) > 0  # a term that the other side holds
            owner, values, order = owner[meets], values[meets], (t + e)[meets]
            by = np.lexsort((values, order, owner))
            owner, values = owner[by], values[by]
            left = np.bincount(owner, minlength=len(sizes))
            # the residual may hold `most` terms: its norm is sqrt(most / n); a partner has at least s * n terms, so its
            # greatest weight is 1 / sqrt(s * n) and the residual adds most / (sqrt(n) * sqrt(s * n)) at most
            by_norm = np.ceil(p.cosine**2 * sizes - 1e-9)
            by_weight = np.ceil(p.cosine * math.sqrt(p.similarity) * sizes - 1e-9)
            most = np.maximum(by_norm, by_weight).astype(np.int64) - 1
            first = np.concatenate([[0], np.cumsum(left)])[:-1]
            take = np.arange(len(owner)) - first[owner] < (left - most)[owner]
            owner, values = owner[take], values[take]
            h, n = batch.column(0).to_numpy(), sizes.astype(np.int32)
            cols = [train[owner], values, h[owner], n[owner], *(s[owner] for s in sketch)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return texts.select("h", "tri", "train").mapInArrow(run, "train boolean, term int, h bigint, n int, s1 bigint, s2 bigint, s3 bigint, s4 bigint")


def cosine_pairs(texts: DataFrame, p: CosineJoin) -> DataFrame:
    """(he, ht, cosine, similarity) of different texts (h, train, n, tri) on the two sides."""
    posted = keep(indexed(texts, p, term_counts(texts, p.buckets)), "cosine-index")
    side = lambda where, x: posted.where(where).select("term", *(F.col(c).alias(c + x) for c in ("h", "n", "s1", "s2", "s3", "s4")))
    s = F.lit(p.similarity)
    agree = F.lit(BITS)
    for k in ("s1", "s2", "s3", "s4"):
        agree = agree - F.bit_count(F.col(k + "e").bitwiseXOR(F.col(k + "t")))
    fits = F.least("ne", "nt") >= s * F.greatest("ne", "nt")
    met = side("NOT train", "e").join(side("train", "t"), "term").where((F.col("he") != F.col("ht")) & fits & (agree >= p.sketch_bits)).select("he", "ht").distinct()
    met = keep(met, "cosine-candidates")
    vec = lambda where, x: by_ids(texts.where(where), met.select(F.col("h" + x).alias("h")).distinct(), "h", "left_semi").select(F.col("h").alias("h" + x), F.col("n").alias("n" + x), F.col("tri").alias("v" + x))
    both = met.join(vec("NOT train", "e"), "he").join(vec("train", "t"), "ht").select("he", "ht", "ne", "nt", F.size(F.array_intersect("ve", "vt")).alias("c"))
    dot = F.col("c") / F.sqrt(F.col("ne").cast("double") * F.col("nt"))
    return (
        both.select("he", "ht", dot.alias("cosine"), (F.col("c") / (F.col("ne") + F.col("nt") - F.col("c"))).alias("similarity"))
        .where(F.col("cosine") >= p.cosine - 1e-9)
        .where(F.col("similarity") >= s)
    )


def cross_split(sides: list[DataFrame], p: CosineJoin = CosineJoin(), train: str = "train") -> tuple[DataFrame, DataFrame]:
    """Overlaps between texts of split ``train`` and all other splits.

    ``sides`` have split, key and text. Returns the members (split, key, h) and the text pairs (he, ht, similarity), equal
    texts included with he = ht; overlaps() expands them.
    """
    rows = reduce(DataFrame.unionByName, sides).where("split IS NOT NULL AND key IS NOT NULL")
    rows = rows.withColumn("train", F.col("split") == train).withColumn("uid", F.monotonically_increasing_id())
    table = shingle_table(rows, "text", ["split", "key", "train", "uid"], p.width, 1, "crosssplit", first="train")
    members = table.select("split", "key", "h").distinct()
    sides_held = table.where("tri IS NOT NULL").groupBy("h").agg(F.max("train").alias("a"), F.min("train").alias("b")).where("a AND NOT b")
    same = sides_held.select(F.col("h").alias("he"), F.col("h").alias("ht"), F.lit(1.0).alias("similarity"))
    near = lambda: cosine_pairs(one_per_text(table, "uid", "train"), p).select("he", "ht", "similarity")
    return members, keep(lambda: near().unionByName(same), "crosssplit-pairs")


def overlaps(members: DataFrame, pairs: DataFrame, train: str = "train") -> DataFrame:
    """(split, eval_key, train_id, similarity) of all overlaps."""
    e = members.where(F.col("split") != train).select("split", F.col("key").alias("eval_key"), F.col("h").alias("he"))
    t = members.where(F.col("split") == train).select(F.col("key").alias("train_id"), F.col("h").alias("ht"))
    return pairs.join(e, "he").join(t, "ht").groupBy("split", "eval_key", "train_id").agg(F.max("similarity").alias("similarity"))


def sides_of(curated: DataFrame, predictions: DataFrame) -> list[DataFrame]:
    """The tables of the project as sides: the curated splits, and the texts of the predictions as a split of their own."""
    return [
        curated.where("split IN ('train', 'val', 'test')").select("split", F.col("hesum_id").alias("key"), "text"),
        predictions.select(F.lit("predictions").alias("split"), F.col("pos").cast("string").alias("key"), "text"),
    ]


def split_report(curated: DataFrame, predictions: DataFrame, p: CosineJoin = ARTICLES) -> DataFrame:
    """Per evaluation split and source of the training row: overlapping keys on both sides, exact and near."""
    members, pairs = cross_split(sides_of(curated, predictions), p)
    found = overlaps(members, pairs)
    source = curated.where("split = 'train'").select(F.col("hesum_id").alias("train_id"), "source").distinct()
    return found.join(source, "train_id").groupBy("split", "source").agg(
        F.countDistinct("eval_key").alias("n_eval"),
        F.countDistinct("train_id").alias("n_train"),
        F.count_if(F.col("similarity") >= 1.0).alias("n_exact"),
        F.count_if(F.col("similarity") < 1.0).alias("n_near"),
    )


def split_rates(curated: DataFrame, predictions: DataFrame, p: CosineJoin = ARTICLES) -> DataFrame:
    """(split, source, n_keys, n_overlapping, rate) of all splits and the rows' own sources, also those without any overlap.

    In the training split a key overlaps if it has a partner in any other. A prediction has the (least) source of the rows of
    the test split with the same text.
    """
    members, pairs = cross_split(sides_of(curated, predictions), p)
    found = keep(overlaps(members, pairs).select("split", "eval_key", "train_id"), "crosssplit-found")
    hit = found.select("split", F.col("eval_key").alias("key")).union(found.select(F.lit("train").alias("split"), "train_id")).distinct().withColumn("hit", F.lit(True))
    own = curated.where("split IN ('train', 'val', 'test') AND hesum_id IS NOT NULL")
    articles = own.where("split = 'test'").groupBy(F.md5("text").alias("m")).agg(F.min("source").alias("source"))
    asked = predictions.where("pos IS NOT NULL").select(F.lit("predictions").alias("split"), F.col("pos").cast("string").alias("key"), F.md5("text").alias("m")).distinct()
    keys = own.select("split", F.col("hesum_id").alias("key"), "source").distinct().unionByName(asked.join(articles, "m", "left").select("split", "key", "source"))
    n, k = F.countDistinct("key"), F.countDistinct(F.when(F.col("hit"), F.col("key")))
    return keys.join(hit, ["split", "key"], "left").groupBy("split", "source").agg(n.alias("n_keys"), k.alias("n_overlapping"), F.round(k / n, 4).alias("rate"))
