"""Corpus encoding with a public byte-level BPE vocabulary (problem 6).

Pre-tokenisation uses no regex. Code points are mapped to a few classes through a lookup table; the
class of a space or an apostrophe also depends on the one or two code points after it, which array
shifts supply. A finite automaton over these classes marks where pieces begin. Each class is a function
from states to states, and composing functions is associative, so the state before every code point
comes from a blocked prefix scan: compose within blocks (all blocks at once), scan the block functions,
apply. The pieces are then encoded by pair merging behind a cache.

Defined results: a null or an empty text has an empty list; every input row has one output row; texts
are processed whole; strings of special tokens are ordinary text; unpaired surrogates can't occur in a
Spark string.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.llm.common import spread

# Automaton: classes of code points and states. -----------------------------------------------------
LETTER, NUMBER, OTHER, APOS1, APOS2, WS_MID, SPACE_LAST, WS_LAST, SEP = range(9)
START, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WS, AFTER_SPACE, NEED1, NEED2 = range(8)
N_STATES = 8
BLOCK = 256
CHUNK = 1 << 21
CACHE_MAX = 400_000
SEP_CP = 0x110000

# The code points with the Unicode property White_Space.
WHITE_SPACE = [
    0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and begins-a-piece flag, by class and state."""
    nxt = np.zeros((9, N_STATES), np.uint8)
    cut = np.ones((9, N_STATES), bool)
    for cls, run in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
        nxt[cls] = run
        cut[cls, [run, AFTER_SPACE]] = False
    # The letters of a contraction continue it; the classes guarantee that they are letters.
    nxt[LETTER, NEED1], nxt[LETTER, NEED2] = START, NEED1
    cut[LETTER, [NEED1, NEED2]] = False
    for cls, need in ((APOS1, NEED1), (APOS2, NEED2)):
        nxt[cls] = need
        nxt[cls, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        cut[cls, [IN_OTHER, AFTER_SPACE]] = False
    nxt[WS_MID] = IN_WS
    cut[WS_MID, IN_WS] = False
    nxt[SPACE_LAST] = AFTER_SPACE
    nxt[WS_LAST] = START
    nxt[SEP] = START
    return nxt, cut


NEXT, CUT = _automaton()


def _class_table() -> np.ndarray:
    table = np.full(SEP_CP + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = WS_MID
    table[SEP_CP] = SEP
    return table


_TABLE: list[np.ndarray] = []


def classes(cps: np.ndarray) -> np.ndarray:
    """Class of each code point, with its right context resolved. ``cps`` ends with a separator."""
    if not _TABLE:
        _TABLE.append(_class_table())
    cls = _TABLE[0][cps]
    white = cls == WS_MID
    last = white.copy()
    last[:-1] &= ~(white[1:] | (cls[1:] == SEP))
    cls[last] = WS_LAST
    cls[last & (cps == 0x20)] = SPACE_LAST
    at = np.flatnonzero(cps == 0x27)
    if len(at):
        padded = np.concatenate([cps, [SEP_CP, SEP_CP]])
        a, b = padded[at + 1], padded[at + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        cls[at[one]] = APOS1
        cls[at[two]] = APOS2
    return cls


def begins(cls: np.ndarray) -> np.ndarray:
    """True where a piece begins, by an associative scan over transition functions."""
    out = np.empty(len(cls), bool)
    state = START
    flat = NEXT.ravel()
    for lo in range(0, len(cls), CHUNK):
        part = cls[lo : lo + CHUNK]
        n = len(part)
        blocks = -(-n // BLOCK)
        padded = np.full(blocks * BLOCK, SEP, np.uint8)
        padded[:n] = part
        grid = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.intp) * N_STATES
        # Within blocks: the function of a block is the composition of its classes' functions.
        fun = np.tile(np.arange(N_STATES, dtype=np.uint8), (blocks, 1))
        for row in grid:
            fun = flat[row[:, None] + fun]
        # Over blocks: inclusive scan by doubling; fun[i] becomes the composition of blocks 0..i.
        step = 1
        while step < blocks:
            fun[step:] = np.take_along_axis(fun[step:], fun[:-step].astype(np.intp), axis=1)
            step *= 2
        now = np.empty(blocks, np.uint8)
        now[0] = state
        now[1:] = fun[:-1, state]
        cuts = np.empty((BLOCK, blocks), bool)
        cut = CUT.ravel()
        for k, row in enumerate(grid):
            key = row + now
            cuts[k] = cut[key]
            now = flat[key]
            if lo + CHUNK < len(cls) and k == (n - 1) % BLOCK:
                state = int(now[-1])
        out[lo : lo + n] = cuts.T.ravel()[:n]
    return out


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces of all texts, the text each belongs to, and its offset (code points) in that text."""
    if not texts:
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    joined = "\n".join(texts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    cps[ends] = SEP_CP
    cls = classes(cps)
    at = np.flatnonzero(begins(cls))
    stop = np.append(at[1:], len(cps))
    keep = cls[at] != SEP
    at, stop = at[keep], stop[keep]
    doc = np.searchsorted(ends, at)
    first = np.concatenate([[0], ends[:-1] + 1])
    return [joined[i:j] for i, j in zip(at.tolist(), stop.tolist())], doc, at - first[doc]


class Merger:
    """Pair merging by rank, cached by piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.cache: dict[str, tuple[int, ...]] = {}

    def __call__(self, piece: str) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            if len(self.cache) >= CACHE_MAX:
                self.cache.clear()
            ids = self.cache[piece] = self._merge(piece.encode("utf-8"))
        return ids

    def _merge(self, raw: bytes) -> tuple[int, ...]:
        """Heap of adjacent pairs over a linked list: n log n also for a piece of megabytes."""
        ranks, n = self.ranks, len(raw)
        if n == 1:
            return (ranks[raw],)
        end = list(range(1, n + 1))  # end of the part that begins at i, 0 once merged away
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(raw[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                r = ranks.get(raw[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i:
                j = before[i]
                r = ranks.get(raw[j:stop])
                if r is not None:
                    heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return tuple(out)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


_MERGERS: dict[str, Merger] = {}


def merger(key: str, raw: bytes) -> Merger:
    """One merger a worker and vocabulary; its cache outlives the task."""
    if key not in _MERGERS:
        _MERGERS[key] = Merger(read_ranks(raw))
    return _MERGERS[key]


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a rank file; the folder is a parameter of the session (``paperloom.tokenizers``)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return f"{spark.conf.get('paperloom.tokenizers', '/opt/tokenizers') if spark else '/opt/tokenizers'}/{name}"


def _groups(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Row ranges of at most CHUNK code points (one longer text stands alone)."""
    lo, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(lengths):
        yield lo, len(lengths)


def encode(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    output: str = "ids",
) -> DataFrame:
    """Token ids of every text.

    ``output``: "ids" gives (key, ids); "offsets" adds ``piece_at`` and ``piece_ids``, the offset in code
    points and the number of ids of every piece, so that any id can be traced to its place in the text;
    "count" gives (key, n_tokens) and never ships the ids back to the JVM.
    Further columns of ``docs`` are pruned. The vocabulary (a fixed file under 1 MB) is broadcast.
    """
    spark = docs.sparkSession
    with open(vocabulary or vocabulary_path(), "rb") as f:
        raw = f.read()
    name, ranks = hashlib.md5(raw).hexdigest(), spark.sparkContext.broadcast(raw)
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    ids = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
    fields = {
        "ids": [ids],
        "offsets": [ids] + [T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in ("piece_at", "piece_ids")],
        "count": [T.StructField("n_tokens", T.LongType())],
    }[output]
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(name, ranks.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _groups([len(t) for t in texts]):
                cut, doc, at = pieces(texts[lo:hi])
                found = [merge(p) for p in cut]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                docs_n = hi - lo
                per_doc = np.bincount(doc, weights=sizes, minlength=docs_n).astype(np.int64)
                keys = batch.column(0).slice(lo, docs_n)
                if output == "count":
                    yield pa.RecordBatch.from_arrays([keys, pa.array(per_doc)], names=[key, "n_tokens"])
                    continue

                def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))

                total = int(sizes.sum())
                flat = np.fromiter(chain.from_iterable(found), np.int32, total)
                columns = [keys, lists(flat, per_doc)]
                if output == "offsets":
                    n_pieces = np.bincount(doc, minlength=docs_n)
                    columns += [lists(at.astype(np.int32), n_pieces), lists(sizes.astype(np.int32), n_pieces)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return spread(source).mapInArrow(run, schema)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Text of every list of ids; an id outside the vocabulary makes the text null."""
    with open(vocabulary or vocabulary_path(), "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())
    source = encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids"))
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {i: b for b, i in read_ranks(ranks.value).items()}
        for batch in batches:
            texts = []
            for x in batch.column(1).to_pylist():
                parts = [names.get(i) for i in x or []]
                texts.append(None if None in parts else b"".join(parts).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
