"""Problem 1: near-duplicate records, by a signature-coordinate inverted join.

A text's signature has ``coordinates`` values, each made of ``rows`` min-hashes of its word runs, so two texts of similarity
s agree on a coordinate with probability s ** rows. Texts are posted under each coordinate-value pair. The number of texts
under a pair is counted first, pre-aggregated; pairs of one text meet nobody and drop out. In the order of these counts a
text that needs ``matches`` collisions must collide outside its ``matches`` - 1 most frequent pairs: these are skipped and
the rest, the prefix, is joined. Candidates then count their collisions over both whole lists of shared pairs (the skipped
ones are probed, not merged), and only those above the match threshold are compared exactly.

Scale: copies are one class before anything is posted, however many there are. Long posting lists are skipped first, and
both joins on pairs are plain shuffle joins, which adaptive execution splits where a key is hot. Nothing is capped. A
candidate must also fit in size, as a similarity s needs set sizes within a factor s.

Defined results: null, empty and short texts (under ``min_words`` words) have no partners; copies are partners, also a row
delivered twice; ties do not arise, the ids order a pair; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shingles import flat, one_per_text, shingle_table
from tallyloom.operators.joins import by_ids
from tallyloom.session import keep


@dataclass(frozen=True)
class NearDup:
    """Parameters. At similarity 0.5, 64 coordinates of 3 rows miss 2 collisions in 0.2 % of pairs, at 0.6 in none of 10^5."""

    width: int = 5
    similarity: float = 0.8
    min_words: int = 1
    coordinates: int = 64
    rows: int = 3
    matches: int = 2
    seed: int = 7


#: What TESTDATA.md states for articles.
ARTICLES = NearDup(width=3, similarity=0.5, min_words=30)


def _signature_keys(values: np.ndarray, off: np.ndarray, p: NearDup) -> np.ndarray:
    """The coordinate-value pairs of each text, hashed to 32 bits with the coordinate's number."""
    rng = np.random.default_rng(p.seed)
    k = p.coordinates * p.rows
    a = rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, k, dtype=np.uint32)
    x = values.view(np.uint32)
    starts = off[:-1]
    out = np.empty((len(starts), p.coordinates), dtype=np.uint64)
    for c in range(p.coordinates):
        key = np.full(len(starts), (c + 1) * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
        for r in range(c * p.rows, (c + 1) * p.rows):
            h = x * a[r] + b[r]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            low = np.minimum.reduceat(h, starts).astype(np.uint64)
            key = (key ^ low) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(33)
        out[:, c] = key
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(texts: DataFrame, p: NearDup) -> DataFrame:
    """(h, keys): the coordinate-value pairs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _signature_keys(*flat(batch.column(1)), p)
                off = np.arange(0, keys.size + 1, p.coordinates, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(keys.reshape(-1)))], names=["h", "keys"])

    return texts.select("h", "tri").mapInArrow(run, "h bigint, keys array<int>")


def _lists(texts: DataFrame, p: NearDup) -> DataFrame:
    """(h, keys): each text's pairs that others share, from rare to frequent."""
    posted = keep(signatures(texts, p), "neardup-signatures").select("h", F.explode("keys").alias("key"))
    frequent = posted.groupBy("key").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    shared = posted.join(frequent, "key")
    lists = shared.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("l")).where(F.size("l") >= p.matches)
    return lists.select("h", F.transform("l", lambda x: x.key).alias("keys"))


def _candidates(texts: DataFrame, p: NearDup) -> DataFrame:
    """(ha, hb), ha < hb: pairs of texts that collide often enough."""
    sized = keep(lambda: _lists(texts, p), "neardup-lists")
    prefix = sized.select("h", F.explode(F.slice("keys", 1, F.size("keys") - (p.matches - 1))).alias("key"))
    met = (
        prefix.select("key", F.col("h").alias("ha"))
        .join(prefix.select("key", F.col("h").alias("hb")), "key")
        .where("ha < hb")
        .select("ha", "hb")
        .distinct()
    )
    a, b = (sized.select(F.col("h").alias("h" + x), F.col("keys").alias("keys" + x)) for x in "ab")
    return met.join(a, "ha").join(b, "hb").where(F.size(F.array_intersect("keysa", "keysb")) >= p.matches).select("ha", "hb")


def similar_texts(texts: DataFrame, p: NearDup) -> DataFrame:
    """(ha, hb, similarity), ha < hb: different texts (h, n, tri) whose similarity reaches the threshold."""
    pairs = keep(lambda: _candidates(texts, p), "neardup-candidates")  # only these meet the texts' own sets
    side = lambda df, x: df.select(*(F.col(n).alias(n + x) for n in ("h", "n", "tri")))
    of = by_ids(texts, pairs.select(F.col("ha").alias("h")).union(pairs.select("hb")).distinct(), "h", "left_semi")
    s = F.lit(p.similarity)
    both = F.size(F.array_intersect("tria", "trib"))
    return (
        pairs.join(side(of, "a"), "ha")
        .join(side(of, "b"), "hb")
        .where(F.least("na", "nb") >= s * F.greatest("na", "nb"))
        .select("ha", "hb", (both / (F.col("na") + F.col("nb") - both)).alias("similarity"))
        .where(F.col("similarity") >= s)
    )


def near_duplicate_pairs(df: DataFrame, key: str = "pos", text: str = "text", p: NearDup = NearDup()) -> DataFrame:
    """(``key``_a, ``key``_b, similarity) for all pairs of rows, copies included."""
    rows = shingle_table(df, text, [key], p.width, p.min_words, "neardup")
    linked = keep(lambda: similar_texts(one_per_text(rows, key), p), "neardup-links")
    member = rows.select("h", F.col(key).alias("_k"))
    a, b = f"{key}_a", f"{key}_b"
    many = member.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    copies = member.join(many, "h", "left_semi")
    within = copies.withColumnRenamed("_k", a).join(copies.withColumnRenamed("_k", b), "h").where(F.col(a) < F.col(b)).select(a, b, F.lit(1.0).alias("similarity"))
    across = linked.join(member.select(F.col("h").alias("ha"), F.col("_k").alias("x")), "ha").join(member.select(F.col("h").alias("hb"), F.col("_k").alias("y")), "hb")
    return within.unionByName(across.select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b), "similarity"))


def near_duplicate_groups(df: DataFrame, key: str = "pos", text: str = "text", p: NearDup = NearDup()) -> DataFrame:
    """(``key``, group, n_links): one row per row; the group is the least ``key`` connected by links, n_links the partners.

    Copies are not expanded. Rows without partner are groups of their own, rows without enough words too.
    """
    rows = shingle_table(df, text, [key], p.width, p.min_words, "neardup")
    texts = rows.groupBy("h").agg(F.min(key).alias("least"), F.count("*").alias("copies"))
    links = keep(lambda: similar_texts(one_per_text(rows, key), p).select("ha", "hb"), "neardup-links")
    label = keep(lambda: components(texts.select("h", "least"), links), "neardup-labels")
    both = links.union(links.select("hb", "ha")).toDF("h", "other")
    degree = both.join(texts.select(F.col("h").alias("other"), "copies"), "other").groupBy("h").agg(F.sum("copies").alias("linked"))
    per_text = texts.join(label, "h").join(degree, "h", "left").select("h", "group", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    found = rows.select(F.col(key).alias("_k"), "h").join(per_text, "h").select("_k", "group", "n_links")
    return df.select(key).join(found, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("group", key).alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(h, group): the least ``least`` of each connected component, by label passing with pointer jumping.

    Each round is written to the shared folder; rounds end when no label changes, which must come, as labels only fall.
    Degrees are bounded by the links, which are joined, never collected.
    """
    both = links.union(links.select("hb", "ha")).toDF("h", "other")
    touched = both.select("h").distinct()
    now = keep(nodes.join(touched, "h", "left_semi").withColumn("group", F.col("least")), "components")
    while True:
        offered = both.join(now.select(F.col("h").alias("other"), F.col("group").alias("g")), "other").groupBy("h").agg(F.min("g").alias("g"))
        step = now.join(offered, "h").select("h", "least", "group", F.least("group", "g").alias("g"))
        top = step.select(F.col("least").alias("g"), F.col("g").alias("gg"))
        after = keep(step.join(top, "g").select("h", "least", F.least("g", "gg").alias("group"), (F.least("g", "gg") != F.col("group")).alias("moved")), "components")
        moved = after.where("moved").limit(1).count()
        now = after.drop("moved")
        if not moved:
            break
    return nodes.join(now.select("h", "group"), "h", "left").select("h", F.coalesce("group", "least").alias("group"))
