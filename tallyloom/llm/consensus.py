"""Problem 6: a consensus label per item, an agreement per item and a reliability per annotator.

Minimax conditional entropy: given the true label c, annotator i gives item j the label k with a probability proportional to
exp(s_i[c, k] + t_j[c, k]). The tilting parameters of annotators and items are the duals of the constraints that expected
and observed confusions agree per annotator and per item; both are regularised, items strongly, as an item has few labels.
Coordinate ascent on the dual: in each round a pass over the items ascends each item's t_j in place, alternating with the
item's label posterior, and sums the gradient and curvature of every s_i; the driver then ascends the s_i. Agreement is
computed from the labels alone and reported separately.

In pairwise tasks an annotator may favour a slot, so an annotator has one s for each of the two slot orders, drawn to a
common one by the regularisation.

Scale: labels are reduced to the last usable one per (item, task, annotator) before anything is grouped, so an item's list
has one entry per annotator at most. Per round a partition returns one table of the annotators' sums. The project has 40
annotators at every scale; ``max_annotators`` checks that bound before any parameter is sent out.

Defined results: rows with a null id, annotator or unusable label are left out; a null time is the earliest; among equal
times the greater pos is the later; an item without usable labels has no row; equal posteriors take the lower label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import keep, ship

RUBRIC = ("1", "2", "3", "4", "5")
PAIRWISE = ("original", "tie", "curated")
LABELS = {"rubric": RUBRIC, "pairwise": PAIRWISE}


@dataclass(frozen=True)
class Entropy:
    rounds: int = 10
    inner: int = 3
    annotator_penalty: float = 2.0
    item_penalty: float = 20.0
    max_annotators: int = 100_000


def usable_labels(log: DataFrame, criterion: str = "faithfulness") -> DataFrame:
    """(task, hesum_id, annotator_id, label, slot): the last usable label of each annotator for each item and task."""
    score = F.col(f"scores.{criterion}")
    winner = F.lower(F.regexp_replace("winner", r"^\s+|\s+$", ""))
    arm = F.when(winner == "tie", "tie").when(winner.isin("a", "b"), F.lower(F.col("slot_map")[winner]))
    label = (
        F.when((F.col("task") == "rubric") & score.between(1, 5), score.cast("string"))
        .when((F.col("task") == "pairwise") & F.col("slot_map").isNotNull() & arm.isin(*PAIRWISE), arm)
    )
    slot = F.when((F.col("task") == "pairwise") & (F.lower(F.col("slot_map")["a"]) == "curated"), 1).otherwise(0)
    at = F.struct(F.coalesce("submitted_at", F.lit("")).alias("t"), "pos")
    rows = log.select("task", "hesum_id", "annotator_id", label.alias("label"), slot.alias("slot"), at.alias("at"))
    rows = rows.where("label IS NOT NULL AND hesum_id IS NOT NULL AND annotator_id IS NOT NULL")
    return rows.groupBy("task", "hesum_id", "annotator_id").agg(F.max_by(F.struct("label", "slot"), "at").alias("v")).select("task", "hesum_id", "annotator_id", "v.label", "v.slot")


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _by_item(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sums per item; ``owner`` is sorted and every item has a label."""
    return np.add.reduceat(values, np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)


def posteriors(owner: np.ndarray, who: np.ndarray, x: np.ndarray, s: np.ndarray, prior: np.ndarray, p: Entropy) -> tuple[np.ndarray, np.ndarray]:
    """(label posteriors q, item parameters t) given the annotators' s: item ascent alternating with the posterior."""
    k = s.shape[1]
    t = np.zeros((int(owner[-1]) + 1, k, k))
    rows = np.arange(len(x))
    seen = np.zeros((len(x), k, k))
    seen[rows, :, x] = 1
    for step in range(p.inner + 1):
        logp = _log_softmax(s[who] + t[owner])  # observation, true label, given label
        q = np.exp(_log_softmax(np.log(prior) + _by_item(logp[rows, :, x], owner)))
        if step < p.inner:
            prob, w = np.exp(logp), q[owner][:, :, None]
            g, h = _by_item(w * (seen - prob), owner), _by_item(w * prob * (1 - prob), owner)
            t = t + (g - p.item_penalty * t) / (h + p.item_penalty)
    return q, t


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, annotator, label) of a batch with list columns who and label."""
    who, lab = batch.column("who"), batch.column("x")
    off = who.offsets.to_numpy()
    owner = np.repeat(np.arange(batch.num_rows), np.diff(off))
    return owner, who.values.to_numpy()[off[0] : off[-1]], lab.values.to_numpy()[lab.offsets.to_numpy()[0] : lab.offsets.to_numpy()[-1]]


def _pieces(batches: Iterator[pa.RecordBatch], size: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, size):
            yield batch.slice(a, size)


def _start(owner: np.ndarray, who: np.ndarray, x: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first pass: posteriors are shares of the votes, and plain confusion counts stand for the gradient."""
    q = np.zeros((int(owner[-1]) + 1, k))
    np.add.at(q, (owner, x), 1.0)
    q /= q.sum(axis=1, keepdims=True)
    g = np.zeros((size, k, k))
    seen = np.zeros((len(x), k, k))
    seen[np.arange(len(x)), :, x] = 1
    np.add.at(g, who, q[owner][:, :, None] * seen)
    return g, np.zeros_like(g), q.sum(axis=0)


def _gradient(owner: np.ndarray, who: np.ndarray, x: np.ndarray, s: np.ndarray, prior: np.ndarray, p: Entropy) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient and curvature of every annotator's parameters, and the labels' posterior mass."""
    q, t = posteriors(owner, who, x, s, prior, p)
    prob, w = np.exp(_log_softmax(s[who] + t[owner])), q[owner][:, :, None]
    seen = np.zeros_like(prob)
    seen[np.arange(len(x)), :, x] = 1
    g, h = np.zeros_like(s), np.zeros_like(s)
    np.add.at(g, who, w * (seen - prob))
    np.add.at(h, who, w * prob * (1 - prob))
    return g, h, q.sum(axis=0)


class _Ascent:
    """The annotators' side of the dual for one task: two parameter tables per annotator, one per slot order."""

    def __init__(self, annotators: int, k: int, p: Entropy):
        self.shape, self.p = (2, annotators, k, k), p
        self.prior = np.full(k, 1 / k)
        self.s: np.ndarray | None = None
        self.pooled: np.ndarray | None = None

    def step(self, g: np.ndarray, h: np.ndarray, mass: np.ndarray) -> None:
        g, h = g.reshape(self.shape), h.reshape(self.shape)
        self.prior = (mass + 1) / (mass.sum() + len(mass))
        if self.s is None:
            base = g.sum(axis=(0, 1)) + 1  # all annotators together smooth each one
            base = base / base.sum(axis=-1, keepdims=True)
            both = g.sum(axis=0, keepdims=True) + 2 * base
            own = g + 4 * both / both.sum(axis=-1, keepdims=True)
            self.pooled, s = np.log(base), np.log(own / own.sum(axis=-1, keepdims=True))
        else:
            s = self.s.reshape(self.shape)
            centre = 0.5 * s.mean(axis=0, keepdims=True) + 0.5 * self.pooled
            pull = self.p.annotator_penalty * (s - centre)
            s = s + np.clip((g - pull) / (h + self.p.annotator_penalty + 0.25 * np.abs(g)), -1, 1)
        self.s = s.reshape(-1, *self.shape[2:])


def _by_task(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    tasks = np.array(batch.column("task").to_pylist())
    for task in LABELS:
        part = batch.filter(pa.array(tasks == task)) if len(tasks) else batch
        if part.num_rows:
            yield task, part


def _fit(items: DataFrame, annotators: int, p: Entropy) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(s, prior) per task; one pass over the items a round serves all tasks."""
    state = {task: _Ascent(annotators, len(labels), p) for task, labels in LABELS.items()}
    for _ in range(p.rounds):
        cast = items.sparkSession.sparkContext.broadcast({task: (a.s, a.prior) for task, a in state.items()})

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, list[np.ndarray]] = {}
            for batch in _pieces(batches):
                for task, part in _by_task(batch):
                    s, prior = cast.value[task]
                    k = len(prior)
                    lists = _lists(part)
                    found = _start(*lists, k, 2 * annotators) if s is None else _gradient(*lists, s, prior, p)
                    total[task] = [a + b for a, b in zip(total[task], found)] if task in total else list(found)
            for task, (g, h, mass) in total.items():
                g, h = np.append(g.reshape(-1), mass), np.append(h.reshape(-1), np.zeros(len(mass)))
                at = np.flatnonzero((g != 0) | (h != 0))  # only the annotators of these items
                cols = [pa.array([task] * len(at)), pa.array(at), pa.array(g[at]), pa.array(h[at])]
                yield pa.RecordBatch.from_arrays(cols, names=["task", "at", "g", "h"])

        out = items.mapInArrow(sums, "task string, at bigint, g double, h double").groupBy("task", "at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        task_of = np.array(out.column("task").to_pylist(), dtype=object)
        for task, a in state.items():
            mine = task_of == task
            k = a.shape[-1]
            g, h = np.zeros(2 * annotators * k * k + k), np.zeros(2 * annotators * k * k + k)
            at = out.column("at").to_numpy()[mine]
            g[at], h[at] = out.column("g").to_numpy()[mine], out.column("h").to_numpy()[mine]
            a.step(g[:-k], h[:-k], g[-k:])
        cast.destroy()
    return {task: (a.s, a.prior) for task, a in state.items()}


def _items(log: DataFrame, p: Entropy) -> tuple[DataFrame, list[str]]:
    """The usable labels as one row per item and task, in the shared folder, and the annotators in order."""
    used = usable_labels(log)
    used = keep(used, "consensus-labels")
    names = [r[0] for r in used.select("annotator_id").distinct().limit(p.max_annotators + 1).collect()]
    if len(names) > p.max_annotators:
        raise ValueError("more annotators than max_annotators")
    names = sorted(names)
    spark = log.sparkSession
    index = F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(names)] or [], "annotator_id string, i int"))
    order = F.create_map(*[F.lit(v) for labels in LABELS.values() for i, label in enumerate(labels) for v in (label, i)])
    entry = F.struct((F.col("i") + F.col("slot") * len(names)).cast("int").alias("who"), order[F.col("label")].cast("int").alias("x"))
    lists = used.join(index, "annotator_id").groupBy("task", "hesum_id").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return keep(lists.select("task", "hesum_id", F.col("l.who").alias("who"), F.col("l.x").alias("x")), "consensus-items"), names


def _judged(log: DataFrame, p: Entropy) -> tuple[DataFrame, dict[str, tuple[np.ndarray, np.ndarray]], list[str]]:
    ship(log.sparkSession)
    items, names = _items(log, p)
    fits = _fit(items, len(names), p)
    cast = items.sparkSession.sparkContext.broadcast(fits)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            for task, part in _by_task(batch):
                s, prior = cast.value[task]
                owner, who, x = _lists(part)
                k = len(prior)
                q, _ = posteriors(owner, who, x, s, prior, p)
                best = q.argmax(axis=1)
                votes = np.zeros((part.num_rows, k))
                np.add.at(votes, (owner, x), 1)
                n = votes.sum(axis=1)
                pairs = n * (n - 1)
                agree = np.where(pairs > 0, (votes * (votes - 1)).sum(axis=1) / np.where(pairs > 0, pairs, 1), np.nan)
                label = [LABELS[task][b] for b in best]
                cols = [part.column("hesum_id"), part.column("task"), pa.array(label), pa.array(q.max(axis=1)), pa.array(n.astype(np.int64)), pa.array(agree, from_pandas=True), pa.array(votes[np.arange(len(best)), best] / n)]
                yield pa.RecordBatch.from_arrays(cols, names=["hesum_id", "task", "label", "confidence", "n_annotators", "pair_agreement", "share"])

    schema = "hesum_id string, task string, label string, confidence double, n_annotators bigint, pair_agreement double, share double"
    return items.mapInArrow(judge, schema), fits, names


def consensus(log: DataFrame, p: Entropy = Entropy(), least: int = 3) -> DataFrame:
    """Per item and task with ``least`` annotators: label, its posterior, annotators, the share of pairs of labels that are
    equal, and the share of labels equal to the consensus."""
    return _judged(log, p)[0].where(F.col("n_annotators") >= least)


def reliability(log: DataFrame, p: Entropy = Entropy()) -> DataFrame:
    """Per annotator and task: labels given, model reliability (the probability of the true label, over the prior), and the
    observed share equal to the consensus of items with three annotators."""
    judged, fits, names = _judged(log, p)
    rows = []
    for task, (s, prior) in fits.items():
        prob = np.exp(_log_softmax(s)).reshape(2, len(names), len(prior), len(prior))
        right = (np.einsum("oacc->oac", prob) * prior).sum(axis=-1)
        right = right[0] if task == "rubric" else right.mean(axis=0)
        rows += [(n, task, float(v)) for n, v in zip(names, right)]
    model = judged.sparkSession.createDataFrame(rows, "annotator_id string, task string, reliability double")
    used = usable_labels(log)
    truth = judged.where("n_annotators >= 3").select("task", "hesum_id", F.col("label").alias("truth"))
    seen = used.join(truth, ["task", "hesum_id"], "left").groupBy("annotator_id", "task").agg(F.count("*").alias("n_labels"), F.avg((F.col("label") == F.col("truth")).cast("double")).alias("agreement"))
    return seen.join(F.broadcast(model), ["annotator_id", "task"]).select("annotator_id", "task", "n_labels", "reliability", "agreement")
