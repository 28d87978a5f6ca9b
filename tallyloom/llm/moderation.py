"""Problem 9: abusive, hateful and sexually explicit content.

A bidirectional gated recurrent network with attention pooling reads windows of words and gives each the probabilities of
clean, abusive, hateful and sexual. A word's input is a learned vector of the word, the mean of learned vectors of its
character runs, and flags from word lists. It is trained in numpy on the labelled samples (a fixed table; ``max_samples``
bounds it), on seed sentences, and on windows without any listed word of ``background`` documents,
with disguises added in training. Windows of ``window`` words start every ``step`` words, so all of every text is scored
and overlaps; a document's score is that of its worst window.

Before words are made, marks and format characters go, compatibility forms are resolved, letters that stand apart by
blanks, dots or dashes are joined, letters repeated three times are reduced and digits inside words become letters.

Scale: the network (under 2 MB) is sent to the workers; documents are scored where they lie, with no shuffle. Words' input
products are computed once per worker and kept in a bounded cache.

Defined results: null, empty and blank texts score 0; a text of any length is scored whole; repeated rows are each scored;
rows with a null source have their own rate; other columns are not read.
"""

from __future__ import annotations

import html
import io
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import moderation_words as lists
from tallyloom.llm.wordform import strip_marks
from tallyloom.session import shared_dir, ship
from tallyloom.sources.files import exists

LABELS = ("clean", "abusive", "hateful", "sexual")
#: Of the training procedure; part of a kept network's name.
VERSION = 2


@dataclass(frozen=True)
class Network:
    window: int = 24
    step: int = 12
    hidden: int = 16
    width: int = 16
    word_rows: int = 1 << 12
    char_rows: int = 1 << 13
    epochs: int = 14
    size: int = 5200
    batch: int = 128
    rate: float = 0.006
    max_samples: int = 20_000
    background: int = 3_000
    mining: tuple[int, ...] = (5, 8, 11)
    seed: int = 5


# ---- words ----

_APART = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*·]){2,}[^\W\d_](?![^\W\d_])")
_STARS = set("*#@$")
_STAR = re.compile(r"(?<=[^\W\d_])[*#@$]+(?=[^\W\d_])")
_DOTTED = re.compile(r"(?<=[^\W\d_])[._·](?=[^\W\d_])")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")
_LEET = str.maketrans("013457@$", "oieastas")
_HAS_BOTH = re.compile(r"(?=.*\d)(?=.*[a-z])")


def plain_words(text: str | None) -> list[str]:
    """The words of a text without disguises."""
    if not text:
        return []
    if not text.isascii():
        text = strip_marks(unicodedata.normalize("NFKC", text))
    if "&" in text:
        text = html.unescape(text)
    text = text.lower()
    text = _APART.sub(lambda m: re.sub(r"[ .\-_*·]", "", m.group()), text)
    if not _STARS.isdisjoint(text):
        text = _STAR.sub("", text)
    text = _DOTTED.sub("", text)
    text = _REPEAT.sub(r"\1", text)
    out = _WORD.findall(text)
    return [w if w.isalpha() or not _HAS_BOTH.match(w) else w.translate(_LEET) for w in out]


_PARTICLES = "והבלכמש"


def _stems(stems: list[str]) -> re.Pattern:
    return re.compile("(?:" + "|".join(sorted(map(re.escape, set(stems)), key=len, reverse=True)) + ")")


_FLAGS = [_stems(s) for s in (lists.ABUSE, lists.HATE, lists.SEX)]


def flags(word: str) -> tuple[int, ...]:
    forms = [word]
    w = word
    for _ in range(2):
        if len(w) > 3 and w[0] in _PARTICLES:
            w = w[1:]
            forms.append(w)
    return tuple(int(any(p.match(f) for f in forms)) for p in _FLAGS)


def _hash(s: str, rows: int) -> int:
    return zlib.crc32(s.encode()) % rows


def word_parts(word: str, net: Network) -> tuple[int, list[int], tuple[int, ...]]:
    """(row of the word's vector, rows of its character runs' vectors, flags)."""
    w = f"<{word}>"
    chars = {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)} if len(w) < 40 else {w[i : i + 3] for i in range(len(w) - 2)}
    return _hash(word, net.word_rows), sorted(_hash(c, net.char_rows) for c in chars), flags(word)


def windows(found: list, net: Network) -> list[list]:
    """Overlapping windows over all words; the last one ends with the text."""
    if len(found) <= net.window:
        return [found]
    starts = [*range(0, len(found) - net.window, net.step), len(found) - net.window]
    return [found[s : s + net.window] for s in starts]


# ---- the network ----


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def init(net: Network) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(net.seed)
    n = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
    d, h = 2 * net.width + 3, net.hidden
    p = {"E": n(net.word_rows, net.width, k=0.1), "C": n(net.char_rows, net.width, k=0.1)}
    for side in "fb":
        p[f"W{side}"], p[f"B{side}"] = n(d, 3 * h, k=d**-0.5), np.zeros(3 * h, np.float32)
    p["U"] = n(2, h, 3 * h, k=h**-0.5)
    p["A"], p["a"] = n(2 * h, h, k=(2 * h) ** -0.5), n(h, k=h**-0.5)
    p["O"], p["o"] = n(2 * h, len(LABELS), k=(2 * h) ** -0.5), np.zeros(len(LABELS), np.float32)
    return p


def _gru(x: np.ndarray, u: np.ndarray, h: int, keep: bool) -> tuple[np.ndarray, list]:
    """x: (steps, ..., rows, 3h) input products; states (steps, ..., rows, h). Gates: update, reset, candidate.

    Both directions go together, as the axis before the rows, with their matrices stacked in ``u``.
    """
    state = np.zeros((*x.shape[1:-1], h), np.float32)
    out, tape = np.empty((*x.shape[:-1], h), np.float32), []
    for t in range(len(x)):
        hu = state @ u
        zr = _sigmoid(x[t, ..., : 2 * h] + hu[..., : 2 * h])
        z, r = zr[..., :h], zr[..., h:]
        c = np.tanh(x[t, ..., 2 * h :] + r * hu[..., 2 * h :])
        new = state + z * (c - state)
        if keep:
            tape.append((state, z, r, c, hu[..., 2 * h :]))
        state = out[t] = new
    return out, tape


def _gru_back(dout: np.ndarray, tape: list, u: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """(d input products, d u)."""
    dx, du = np.empty((*dout.shape[:-1], 3 * h), np.float32), np.zeros_like(u)
    ds, back = np.zeros(dout.shape[1:], np.float32), np.ascontiguousarray(np.swapaxes(u, -1, -2))
    for t in range(len(tape) - 1, -1, -1):
        state, z, r, c, hc = tape[t]
        ds = ds + dout[t]
        dc = ds * z * (1 - c * c)
        dz = ds * (c - state) * z * (1 - z)
        dr = dc * hc * r * (1 - r)
        dx[t] = dhu = np.concatenate([dz, dr, dc], axis=-1)
        dhu[..., 2 * h :] *= r
        du += np.swapaxes(state, -1, -2) @ dhu
        ds = ds * (1 - z) + dhu @ back
    return dx, du


def _both(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """(steps, 2, rows, k) of two directions' (steps, rows, k)."""
    return np.stack([forward, backward], axis=1)


def _joined(hs: np.ndarray) -> np.ndarray:
    """(steps, rows, 2h) from the states of both directions, in the order of the text."""
    return np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2)


def _pool(hs: np.ndarray, mask: np.ndarray, p: dict) -> tuple[np.ndarray, ...]:
    """Attention over (steps, rows, 2h); mask (steps, rows) is true on words."""
    v = np.tanh(hs @ p["A"])
    e = np.where(mask, v @ p["a"], -30).astype(np.float32)
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", w, hs)
    return v, w, pooled


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def grouped(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, the sum of each one's rows)."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[at], np.add.reduceat(rows[by], at, axis=0) if len(at) else rows[:0]


class Vocabulary:
    """Distinct words of a training set as rows of a sparse averaging matrix."""

    def __init__(self, net: Network):
        self.net, self.index = net, {"": 0}
        self.rows: list[tuple[int, list[int], tuple[int, ...]]] = [(0, [], (0, 0, 0))]

    def __call__(self, word: str) -> int:
        i = self.index.get(word)
        if i is None:
            i = self.index[word] = len(self.rows)
            self.rows.append(word_parts(word, self.net))
        return i

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word row, flags, owner of each character run, its row); row 0 is the padding."""
        e = np.array([r[0] for r in self.rows])
        f = np.array([r[2] for r in self.rows], np.float32)
        owner = np.repeat(np.arange(len(self.rows)), [len(r[1]) for r in self.rows])
        return e, f, owner, np.array([c for r in self.rows for c in r[1]], dtype=np.int64)


def vectors(p: dict, rows: list[tuple[int, list[int], tuple[int, ...]]]) -> np.ndarray:
    """Inputs of words given by their parts."""
    width = p["E"].shape[1]
    out = np.zeros((len(rows), 2 * width + 3), np.float32)
    for i, (e, chars, fl) in enumerate(rows):
        out[i, :width] = p["E"][e]
        out[i, width : 2 * width] = p["C"][chars].mean(axis=0) if chars else 0
        out[i, 2 * width :] = fl
    return out


def likely_clean(background: list[list[str]], by: dict[str, list[list[str]]]) -> list[list[str]]:
    """Background windows without two words that labelled bad texts have and the background nearly lacks."""
    seen: dict[str, int] = {}
    for ws in background:
        for w in set(ws):
            seen[w] = seen.get(w, 0) + 1
    rare = {w for y in LABELS[1:] for ws in by[y] for w in ws if seen.get(w, 0) <= max(1, len(background) // 2000)}
    return [ws for ws in background if sum(w in rare for w in ws) < 2]


def hard_windows(p: dict, background: list[list[str]], net: Network) -> list[list[str]]:
    scorer = Scorer(p, net)
    ids = np.zeros((len(background), net.window), np.int32)
    for i, ws in enumerate(background):
        scorer._rows(ws)
        ids[i, : len(ws)] = [scorer.index[w] for w in ws[: net.window]]
    return [background[i] for i in np.flatnonzero(1 - scorer._windows(ids)[:, 0] > 0.15)]


def piece(seq: list[str], most: int, rng: np.random.Generator) -> list[str]:
    """A text of up to ``most`` words as it is, of a longer one any run of ``most`` words."""
    at = int(rng.integers(len(seq) - most + 1)) if len(seq) > most else 0
    return seq[at : at + most]


def train(sentences: list[tuple[str, str]], background: list[list[str]], net: Network) -> dict[str, np.ndarray]:
    """Fit on (sentence, label) and on background windows as words, which are clean."""
    rng = np.random.default_rng(net.seed)
    p = init(net)
    by = {label: [plain_words(s) for s, y in sentences if y == label] for label in LABELS}
    by["clean"] = [w for w in by["clean"] if w] or [["-"]]
    rest = likely_clean(background, by) or by["clean"]
    bad = [y for y in LABELS[1:] if any(by[y])]

    def disguise(w: str) -> str:
        k = rng.integers(4)
        if len(w) < 3 or k == 3:
            return w
        i = int(rng.integers(1, len(w)))
        return (w[:i] + w[i] + w[i:], w[:i] + w[i + 1 :], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :])[k]

    def clean_part(n: int) -> list[str]:
        source = by["clean"] if rng.random() < 0.4 else rest
        w = source[rng.integers(len(source))]
        if len(w) > n:
            s = int(rng.integers(len(w) - n + 1))
            w = w[s : s + n]
        return w

    vocabulary = Vocabulary(net)
    x, y = np.zeros((net.size, net.window), np.int64), np.zeros(net.size, np.int64)
    for i in range(net.size):
        label = bad[rng.integers(len(bad))] if bad and rng.random() < 0.5 else "clean"
        if label == "clean":
            seq = rest[rng.integers(len(rest))] if rng.random() < 0.5 else clean_part(net.window)
            seq = seq[int(rng.integers(len(seq))) if rng.random() < 0.5 else 0 :][: net.window]
            while len(seq) < net.window and rng.random() < 0.75:
                seq = seq + clean_part(net.window - len(seq))
        else:
            core = piece(by[label][rng.integers(len(by[label]))], net.window, rng)
            core = [disguise(w) if any(flags(w)) and rng.random() < 0.35 else w for w in core]
            room = net.window - len(core)
            a = clean_part(int(rng.integers(room + 1))) if room and rng.random() < 0.8 else []
            b = clean_part(room - len(a)) if room > len(a) and rng.random() < 0.8 else []
            seq = a + core + b
        x[i, : len(seq)] = [vocabulary(w) if rng.random() > 0.04 else vocabulary("unseenword") for w in seq]
        y[i] = LABELS.index(label)
    for w in {w for ws in rest for w in ws}:
        vocabulary(w)
    e, f, owner, chars = vocabulary.arrays()
    share = (1 / np.maximum(np.bincount(owner, minlength=len(e)), 1)).astype(np.float32)
    first = np.searchsorted(owner, np.arange(len(e) + 1))
    h, width = net.hidden, net.width
    clean_rows = np.flatnonzero(y == 0)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    count = 0
    for epoch in range(net.epochs):
        if epoch in net.mining:  # background windows that still look bad take the place of some clean rows
            hard = hard_windows(p, rest, net)
            for row in rng.permutation(clean_rows)[: min(len(clean_rows) // 4, 12 * len(hard))]:
                seq = hard[rng.integers(len(hard))]
                x[row] = 0
                x[row, : len(seq)] = [vocabulary(w) for w in seq]
        order = rng.permutation(net.size)
        for at in range(0, net.size, net.batch):
            pick = order[at : at + net.batch]
            xb, yb = x[pick].T, y[pick]  # steps x rows
            ids, inv = np.unique(xb, return_inverse=True)
            inv = inv.reshape(xb.shape)
            sizes = first[ids + 1] - first[ids]
            own = np.repeat(np.arange(len(ids)), sizes)
            flat_c = np.arange(len(own)) + np.repeat(first[ids] - np.cumsum(sizes) + sizes, sizes)
            vec = np.zeros((len(ids), 2 * width + 3), np.float32)
            drop = (rng.random(len(ids)) > 0.3).astype(np.float32)[:, None]  # the word's own vector may be missing
            vec[:, :width] = p["E"][e[ids]] * drop
            has, sums = grouped(own, p["C"][chars[flat_c]])
            vec[has, width : 2 * width] = sums * share[ids[has]][:, None]
            vec[:, 2 * width :] = f[ids]
            vec[ids == 0] = 0
            mask = xb > 0
            x2 = _both((vec @ p["Wf"] + p["Bf"])[inv], (vec @ p["Wb"] + p["Bb"])[inv[::-1]])
            hs, tape = _gru(x2, p["U"], h, True)
            hs = _joined(hs)
            att, w, pooled = _pool(hs, mask, p)
            prob = _softmax(pooled @ p["O"] + p["o"])
            target = np.full_like(prob, 0.02 / 4)
            target[np.arange(len(yb)), yb] += 0.98
            d = (prob - target) / len(yb)
            g = {"O": pooled.T @ d, "o": d.sum(axis=0)}
            dpool = d @ p["O"].T
            dw = np.einsum("nh,tnh->tn", dpool, hs)
            de = w * (dw - (w * dw).sum(axis=0))
            g["a"] = np.einsum("tnk,tn->k", att, de)
            datt = de[:, :, None] * p["a"] * (1 - att * att)
            g["A"] = np.einsum("tnh,tnk->hk", hs, datt)
            dhs = w[:, :, None] * dpool + datt @ p["A"].T
            dx, g["U"] = _gru_back(_both(dhs[:, :, :h], dhs[::-1, :, h:]), tape, p["U"], h)
            dxf, dxr = dx[:, 0], dx[:, 1]
            _, total = grouped(inv.reshape(-1), np.concatenate([dxf, dxr[::-1]], axis=2).reshape(-1, 6 * h))
            tot_f, tot_b = total[:, : 3 * h], total[:, 3 * h :]
            g["Wf"], g["Bf"], g["Wb"], g["Bb"] = vec.T @ tot_f, tot_f.sum(axis=0), vec.T @ tot_b, tot_b.sum(axis=0)
            dvec = tot_f @ p["Wf"].T + tot_b @ p["Wb"].T
            dvec[ids == 0] = 0
            count += 1
            rate = net.rate * (1 - 0.9 * epoch / net.epochs) * np.sqrt(1 - 0.999**count) / (1 - 0.9**count)
            sparse = {"E": (e[ids], dvec[:, :width] * drop), "C": (chars[flat_c], dvec[own, width : 2 * width] * share[ids][own][:, None])}
            for k, (rows, dv) in sparse.items():
                u, gs = grouped(rows, dv)
                m[k][u] = 0.9 * m[k][u] + 0.1 * gs
                v[k][u] = 0.999 * v[k][u] + 0.001 * gs * gs
                p[k][u] -= (rate * (m[k][u] / (np.sqrt(v[k][u]) + 1e-8) + 0.01 * p[k][u])).astype(np.float32)
            for k, gk in g.items():
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                p[k] = (p[k] - rate * (m[k] / (np.sqrt(v[k]) + 1e-8) + 0.002 * p[k])).astype(np.float32)
    return p


class Scorer:
    """The trained network over texts, with a bounded cache of words' input products."""

    def __init__(self, p: dict[str, np.ndarray], net: Network, limit: int = 200_000):
        self.p, self.net, self.limit = p, net, limit
        self.w = np.concatenate([p["Wf"], p["Wb"]], axis=1)
        self.b = np.concatenate([p["Bf"], p["Bb"]])
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.empty((4096, len(self.b)), np.float32)
        self.table[0] = self.b  # padding
        self.used = 1

    def _rows(self, found: list[str]) -> None:
        new = [w for w in dict.fromkeys(found) if w not in self.index]
        if not new:
            return
        need = self.used + len(new)
        if need > len(self.table):
            bigger = np.empty((max(need, 2 * len(self.table)), self.table.shape[1]), np.float32)
            bigger[: self.used] = self.table[: self.used]
            self.table = bigger
        self.table[self.used : need] = vectors(self.p, [word_parts(w, self.net) for w in new]) @ self.w + self.b
        self.index.update(zip(new, range(self.used, need)))
        self.used = need

    def _windows(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities of windows given as (rows, window) word rows."""
        h, out = self.net.hidden, []
        for a in range(0, len(ids), 1024):
            x = ids[a : a + 1024].T
            t = self.table[x]
            hs, _ = _gru(_both(t[:, :, : 3 * h], t[::-1, :, 3 * h :]), self.p["U"], h, False)
            _, _, pooled = _pool(_joined(hs), x > 0, self.p)
            out.append(_softmax(pooled @ self.p["O"] + self.p["o"]))
        return np.concatenate(out) if out else np.empty((0, len(LABELS)), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """(texts, labels): each label's highest probability over the text's windows; clean is the least of its own."""
        found = [plain_words(t) for t in texts]
        if self.used > self.limit:
            self._reset()
        for f in found:
            self._rows(f)
        get = self.index.__getitem__
        cut, owner = [], []
        for i, f in enumerate(found):
            if f:
                part = windows([get(w) for w in f], self.net)
                cut += part
                owner += [i] * len(part)
        ids = np.zeros((len(cut), self.net.window), np.int32)
        for i, c in enumerate(cut):
            ids[i, : len(c)] = c
        prob = self._windows(ids)
        out = np.zeros((len(texts), len(LABELS)))
        out[:, 0] = 1
        if cut:
            own = np.array(owner)
            np.minimum.at(out[:, 0], own, prob[:, 0])
            for k in range(1, len(LABELS)):
                np.maximum.at(out[:, k], own, prob[:, k])
        return out


def background_windows(docs: DataFrame, net: Network) -> list[list[str]]:
    """The windows, as words, without any listed word of a bounded sample of documents.

    The documents are those of the least hashes; only a share that holds about twice as many is sorted and sent.
    """
    docs = docs.where("text IS NOT NULL")
    share = min(1.0, 2 * net.background / max(docs.count(), 1))
    least = F.xxhash64("doc_id") <= min(2**63 - 1, int(-(2**63) + share * 2**64))
    rows = docs.where(least).select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(net.background).collect()
    flagged = cache(lambda w: any(flags(w)))
    return [w for _, text in sorted(rows) for w in windows(plain_words(text), net) if w and not any(map(flagged, w))]


def fit(docs: DataFrame, samples: DataFrame, net: Network = Network()) -> dict[str, np.ndarray]:
    """Train on the labelled samples, the seeds and the background.

    A fitted network is kept in the shared folder under a digest of all that it was trained on, and read from there by the
    next query over the same data.
    """
    spark = docs.sparkSession
    known = samples.where(F.col("label").isin(*LABELS) & F.col("text").isNotNull()).select("text", "label")
    rows = known.orderBy(F.xxhash64("text", "label"), "text", "label").limit(net.max_samples).collect()
    labelled = sorted((r[0], r[1]) for r in rows)
    labelled += [(s, label) for label, block in lists.SEEDS.items() for s in block.strip().splitlines()]
    background = background_windows(docs, net)
    digest = xxhash.xxh3_128_hexdigest(repr((VERSION, net, labelled, background)).encode("utf-8", "surrogatepass"))
    path = f"{shared_dir(spark).rstrip('/')}/tallyloom-moderation-{digest}"
    if exists(spark, f"{path}/_SUCCESS"):
        return dict(np.load(io.BytesIO(spark.read.parquet(path).first()[0])))
    model = train(labelled, background, net)
    out = io.BytesIO()
    np.savez(out, **model)
    spark.createDataFrame([(bytearray(out.getvalue()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return model


def scores(docs: DataFrame, samples: DataFrame, net: Network = Network()) -> DataFrame:
    """(doc_id, source, score, label, abusive, hateful, sexual); score is that of the worst window, 0 to 1."""
    spark = ship(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(docs, samples, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value, net)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                p = scorer(part.column(2).to_pylist())
                score = 1 - p[:, 0]
                label = [LABELS[1 + k] if s >= 0.5 else LABELS[0] for k, s in zip(p[:, 1:].argmax(axis=1), score)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array(label), *(pa.array(p[:, k]) for k in (1, 2, 3))], names=["doc_id", "source", "score", "label", "abusive", "hateful", "sexual"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, score double, label string, abusive double, hateful double, sexual double")


def source_rates(docs: DataFrame, samples: DataFrame, threshold: float = 0.5, net: Network = Network()) -> DataFrame:
    """Per source: documents, documents at or above the threshold by label, and their share."""
    s = scores(docs, samples, net)
    hit = F.col("score") >= threshold
    return s.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.count_if(hit).alias("n_flagged"),
        *(F.count_if(hit & (F.col("label") == label)).alias(f"n_{label}") for label in LABELS[1:]),
        F.round(F.count_if(hit) / F.count("*"), 4).alias("flag_rate"),
        F.round(F.avg("score"), 4).alias("mean_score"),
    )
