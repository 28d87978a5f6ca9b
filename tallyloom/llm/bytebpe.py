"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

Pre-tokenisation works on arrays of code-point classes. The pattern of the vocabulary (contractions, an optional blank
before a run of letters, digits or other characters, white space that leaves its last blank to the next word) is a small
automaton, so each code point is a transition function over its states. Functions are composed block by block and the
block functions by an associative prefix scan; a second pass then reads off the states and with them the boundaries of all
texts of a batch at once. The slices go through cached pair merging.

Defined results: a null and an empty text have the empty list; a text of any length is encoded whole; the strings of
special tokens are ordinary text; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Classes of code points; A2 and A3 are apostrophes that a contraction of 1 or 2 letters follows, END parts texts.
LETTER, DIGIT, OTHER, BLANK, SPACE, A2, A3, END = range(8)
# States: the run that the last code point belongs to; IN1 and IN2 await letters of a contraction; CUT: the next starts anew.
IN1, IN2, CUT = 5, 6, 7
#: Fixed value: Unicode's White_Space besides U+0020.
_WHITE = (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_BLOCK = 128


@cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[list(_WHITE)] = SPACE
    out[32] = BLANK
    return out


@cache
def _transitions() -> np.ndarray:
    """next state of class * 8 + state."""
    t = np.empty((8, 8), dtype=np.uint8)
    for cls in (LETTER, DIGIT, OTHER, BLANK, SPACE):
        t[cls] = cls
    t[LETTER, IN2], t[LETTER, IN1] = IN1, CUT
    t[A2], t[A3], t[END] = IN1, IN2, CUT
    t[A2, [OTHER, BLANK]] = t[A3, [OTHER, BLANK]] = OTHER  # an apostrophe inside a run of other characters
    return t.reshape(-1)


def _compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return np.take_along_axis(then, first, axis=1)


def scan_states(cls: np.ndarray) -> np.ndarray:
    """The automaton's state after each code point, from associative composition of transition functions."""
    n = len(cls)
    blocks = -(-n // _BLOCK)
    grid = np.full(blocks * _BLOCK, END, dtype=np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T).astype(np.intp) * 8
    t = _transitions()
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for column in grid:
        whole = t[column[:, None] + whole]
    step = 1
    while step < blocks:  # inclusive prefix scan over the block functions
        whole[step:] = _compose(whole[:-step], whole[step:])
        step *= 2
    state = np.empty(blocks, dtype=np.uint8)
    state[0], state[1:] = CUT, whole[:-1, CUT]
    out = np.empty((_BLOCK, blocks), dtype=np.uint8)
    for i, column in enumerate(grid):
        state = out[i] = t[column + state]
    return out.T.reshape(-1)[:n]


def boundaries(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start; ``ends`` marks the separator positions, which are pieces of their own."""
    cls = _classes()[code]
    nxt = np.append(code[1:], [0])
    nxt2 = np.append(code[2:], [0, 0])[: len(code)]
    apostrophe = code == 39
    one = np.isin(nxt, [ord(c) for c in "sdmt"])
    two = ((nxt == ord("l")) & (nxt2 == ord("l"))) | ((nxt == ord("v")) & (nxt2 == ord("e"))) | ((nxt == ord("r")) & (nxt2 == ord("e")))
    cls[apostrophe & two], cls[apostrophe & one] = A3, A2
    cls[ends] = END
    # a separator is written as U+0000, so it can't be taken for the letters of a contraction
    state = scan_states(cls)
    before = np.append([CUT], state[:-1])
    starts = before == CUT
    starts |= cls == END
    letter, digit = cls == LETTER, cls == DIGIT
    starts |= letter & ~np.isin(before, (LETTER, BLANK, IN1, IN2))
    starts |= digit & ~np.isin(before, (DIGIT, BLANK))
    starts |= np.isin(cls, (OTHER, A2, A3)) & ~np.isin(before, (OTHER, BLANK))
    white = (cls == BLANK) | (cls == SPACE)
    in_white = (before == BLANK) | (before == SPACE)
    after = np.append(cls[1:], [END])
    last = ~np.isin(after, (BLANK, SPACE, END))  # white space before a text's end stays one piece
    starts |= white & (~in_white | last)
    return np.flatnonzero(starts)


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary file: a token in base 64 and its rank on each line."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(a): int(b) for a, b in pairs}


class Merger:
    """Byte pairs merged by rank, with a bounded cache of pieces."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 300_000):
        self.ranks, self.limit = ranks, limit
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if data in ranks:
            return (ranks[data],)
        # a linked list of parts and a heap of the pairs that may merge: n log n for a piece of any length
        n = len(data)
        end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of the parts has merged meanwhile
            end[i], alive[j], nxt[i] = stop, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if (r := ranks.get(data[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prv[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = nxt[i]
        return tuple(out)

    def __call__(self, pieces: list[str]) -> list[tuple[int, ...]]:
        if len(self.cache) > self.limit:
            self.cache.clear()
        get = self.cache.get
        out = list(map(get, pieces))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    p = pieces[i]
                    ids = get(p)
                    if ids is None:
                        ids = self.merge(p.encode())
                        if len(p) <= 64:
                            self.cache[p] = ids
                    out[i] = ids
        return out


def parts_of(batch: pa.RecordBatch, text: int, rows: int = 1000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and, but for single longer texts, ``chars`` bytes of text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + chars, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def encode_batch(texts: list[str | None], merger: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ids' offset of each text, code-point starts of the pieces, pieces' offset of each text, ids of each piece)."""
    parts = [t or "" for t in texts]
    big = "\0".join(parts) + "\0"
    code = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    seps = np.cumsum(lengths + 1) - 1
    starts = boundaries(code, seps)
    stops = np.append(starts[1:], len(code))
    real = ~np.isin(starts, seps, assume_unique=True)
    starts, stops = starts[real], stops[real]
    lists = merger([big[a:b] for a, b in zip(starts.tolist(), stops.tolist())])
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    ids = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(sizes.sum()))
    piece_off = np.append([0], np.searchsorted(starts, seps))
    id_off = np.append([0], np.cumsum(sizes))[piece_off]
    owner = np.repeat(np.arange(len(parts)), np.diff(piece_off))
    return ids, id_off, starts - (seps - lengths)[owner], piece_off, sizes


def encode(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keys: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """``keys`` and ``ids`` of each row; with ``spans`` also ``starts``, the code-point offset of each piece, and ``piece_ids``, how many ids it has."""
    spark = ship(df.sparkSession)
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))  # a fixed vocabulary of some 50,000 entries
    picked = df.select(*keys, F.col(text).alias("_text"))
    schema = picked.drop("_text").schema.add("ids", T.ArrayType(T.IntegerType()))
    if spans:
        schema = schema.add("starts", T.ArrayType(T.IntegerType())).add("piece_ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(ranks.value)
        for batch in batches:
            for part in parts_of(batch, batch.num_columns - 1):
                texts = part.column(part.num_columns - 1).to_pylist()
                ids, id_off, starts, piece_off, sizes = encode_batch(texts, merger)
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                cols.append(pa.ListArray.from_arrays(pa.array(id_off, pa.int32()), pa.array(ids, pa.int32())))
                if spans:
                    cols += [pa.ListArray.from_arrays(pa.array(piece_off, pa.int32()), pa.array(v, pa.int32())) for v in (starts, sizes)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return picked.mapInArrow(run, schema)


def decode_ids(ids, tokens: dict[int, bytes]) -> str:
    """The text of a list of ids."""
    return b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


def token_rates(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per source: documents, tokens, tokens per character, and documents whose ids decode to the very text."""
    spark = ship(df.sparkSession)
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(ranks.value)
        tokens = {v: k for k, v in ranks.value.items()}
        for batch in batches:
            for part in parts_of(batch, 1):
                texts = part.column(1).to_pylist()
                ids, off, *_ = encode_batch(texts, merger)
                ids = ids.tolist()
                n = np.diff(off)
                back = [decode_ids(ids[a:b], tokens) == (t or "") for t, a, b in zip(texts, off, off[1:])]
                chars = [len(t or "") for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(chars, pa.int64()), pa.array(back, pa.bool_())], names=["source", "n", "chars", "back"])

    counted = df.select("source", "text").mapInArrow(run, "source string, n bigint, chars bigint, back boolean")
    return counted.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.sum("n").alias("n_tokens"),
        F.sum("chars").alias("n_chars"),
        F.count_if(F.col("n") == 0).alias("n_empty"),
        F.count_if("back").alias("n_round_trip"),
    )
