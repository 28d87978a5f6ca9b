"""Problem 8: passages of evaluation items inside corpus documents.

All runs of ``run`` consecutive words of the items form one Aho-Corasick automaton over word numbers. A document's words
are looked up in the items' vocabulary and its sequence goes through the automaton once; hits carry word positions, which
map to offsets in the original text. The items are the stated query set: where they have more runs than ``block_runs``,
they go through in blocks, each with an automaton of its own, against all documents. The driver fetches one block at a
time and hands it to Spark's broadcast; a worker process builds the automaton once and keeps it for its next tasks.

Defined results: null, empty and shorter texts hold nothing; an item with fewer words than ``run`` can't be found; repeated
items and repeated documents are each reported under their own id; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.wordform import words, words_with_spans
from tallyloom.session import ship

RUN = 12
#: Runs of words in one automaton at most (about 0.3 KB each in a worker).
BLOCK_RUNS = 300_000


class ItemAutomaton:
    """The automaton of some items; ``items`` are (item_id, text)."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN):
        self.run, self.vocabulary = run, {}
        owners: dict[tuple[int, ...], list[int]] = {}
        number = self.vocabulary
        for item, text in items:
            seq = [number.setdefault(w, len(number) + 1) for w in words(text)]
            for i in range(len(seq) - run + 1):
                own = owners.setdefault(tuple(seq[i : i + run]), [])
                if not own or own[-1] != item:
                    own.append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for seq, own in owners.items():
            self.automaton.add_word(seq, own)
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def hits(self, found: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(number of the run's last word, items that hold the run)."""
        if self.empty or len(found) < self.run:
            return iter(())
        get = self.vocabulary.get
        return self.automaton.iter(tuple([get(w, 0) for w in found]))


_BUILT: dict[str, ItemAutomaton] = {}


def automaton_of(block: Broadcast, run: int) -> ItemAutomaton:
    """The automaton of a broadcast block; a process keeps the last one."""
    name, items = block.value
    key = f"{name} {run}"
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ItemAutomaton(items, run)
    return _BUILT[key]


def item_blocks(items: DataFrame, block_runs: int) -> list[Broadcast]:
    """The items in blocks of a bounded number of runs; their number is counted before any is fetched."""
    sized = items.select("item_id", "text").withColumn("_n", F.length(F.coalesce("text", F.lit(""))) / 2 + 1)
    total = sized.agg(F.sum("_n")).first()[0] or 0  # a word and a blank take two characters at least
    blocks = int(total // block_runs) + 1
    sc = items.sparkSession.sparkContext

    def block(k: int) -> Broadcast:
        part = items.select("item_id", "text").where((F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else F.lit(True))
        return sc.broadcast((uuid.uuid4().hex, sorted({(r[0], r[1]) for r in part.collect() if r[0] is not None and r[1] is not None})))

    return [block(k) for k in range(blocks)]


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """(doc_id, item_id) for each document that has ``run`` consecutive words in common with an item."""
    ship(docs.sparkSession)
    texts = docs.select("doc_id", "text")

    def block(part: Broadcast) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = automaton_of(part, run)
            for batch in batches:
                out_d, out_i = [], []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    got: set[int] = set()
                    for _, own in auto.hits(words(t)):
                        got.update(own)
                    out_d.extend([d] * len(got))
                    out_i.extend(sorted(got))
                yield pa.RecordBatch.from_arrays([pa.array(out_d, pa.int64()), pa.array(out_i, pa.int64())], names=["doc_id", "item_id"])

        return texts.mapInArrow(scan, "doc_id bigint, item_id bigint")

    return reduce(DataFrame.unionByName, [block(p) for p in item_blocks(items, block_runs)]).distinct()


def passages(docs: DataFrame, items: DataFrame, run: int = RUN, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """Maximal leaked passages: document, item, [start, end) in code points of the original text, words."""
    ship(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    names = ["doc_id", "item_id", "start", "end", "n_words"]

    def block(part: Broadcast) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = automaton_of(part, run)
            for batch in batches:
                rows: list[tuple] = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found, spans = words_with_spans(t)
                    open_: dict[int, list[int]] = {}
                    done: list[tuple[int, int, int]] = []
                    for last, own in auto.hits(found):
                        for item in own:
                            have = open_.get(item)
                            if have and last - run + 1 <= have[1] + 1:
                                have[1] = last
                            else:
                                if have:
                                    done.append((item, *have))
                                open_[item] = [last - run + 1, last]
                    done += [(item, *have) for item, have in open_.items()]
                    rows += [(d, item, spans[a][0], spans[b][1], b - a + 1) for item, a, b in sorted(done)]
                cols = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        return texts.mapInArrow(scan, "doc_id bigint, item_id bigint, start int, end int, n_words int")

    return reduce(DataFrame.unionByName, [block(p) for p in item_blocks(items, block_runs)])


def item_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per leaked test item: documents and sources that hold it, and the longest passage in words."""
    found = passages(docs, items)
    by_doc = found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
    source = docs.select(F.col("doc_id").alias("_d"), "source")
    known = items.select(F.col("item_id").alias("_i"), "split").distinct()
    return (
        by_doc.join(source, by_doc.doc_id == source._d)
        .groupBy("item_id")
        .agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.max("n_words").alias("longest"))
        .join(known, F.col("item_id") == F.col("_i"))
        .select("item_id", "split", "n_docs", "n_sources", "longest")
    )
