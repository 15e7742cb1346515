"""Records of evaluation splits that are in the training split too, exactly or almost (problem 5).

Texts become sequences of words, folded so that what scanning confuses is equal (case, line breaks, words
divided at line ends, digits and letter groups that look alike). Records with the same sequence form a class
with one representative.

A suffix array over the concatenated sequences of all representatives, range partitioned over the cluster, puts
suffixes that go on alike side by side. Texts of fewer than ``DENSE`` words begin a suffix at every word. In
longer ones the array is sparse: suffixes begin at anchors, words whose trigram hash is least among its
neighbours, so that two texts with a shared span begin suffixes at the same words of it. Suffixes are sorted by
their next twelve words, ties by what follows (hashes of the next 4, 12 and 36 words and of all that is left, in
this order, so that suffixes that agree for longer stand closer) and at last by record. Neighbours in this order,
those on either side of a partition's border included, with at least ``MIN_LCP`` equal words are a shared span: two
records, two positions, a length. Each suffix meets only its neighbours: work is linear however many records
share a phrase, and copies of a page still form a chain, because what only they share puts them side by side.

The spans of two records are merged into covered intervals. Where these reach ``NOMINATE`` of the shorter record, its
spans are extended in the full texts along their diagonals (difference of positions) and those ``DRIFT`` words to
either side, over single differing words; equal stretches of three words and more are merged into the coverage
of the shorter record, which decides. Accepted links are closed by connected components (copies of one page),
and the pairs across splits come from these.

Defined results: null, empty and wordless texts have no case; repeated rows count once; a document in several
splits counts in each; texts are compared whole; texts of fewer than three words are compared for equality.
"""

from __future__ import annotations

import itertools
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import components, spread
from paperloom.session import broadcast_if_small, materialize

KEYED = 12  # words of a suffix that are sorted word by word; what follows is sorted by hashes
LEVELS = (16, 24, 48)  # ends of the hashed stretches, the last one being the whole rest
DENSE = 64
GROUP_WORDS = 1 << 16  # words whose suffixes are computed together
MIN_LCP, MIN_LCP_SHORT = 5, 3
NOMINATE = 0.05
DRIFT = 3
SPAN = 3
COVERED = 0.8
GOLD_BROADCAST_ROWS = 500_000

# The mark first, the letter before it next: the engine searches for marks instead of looking back at every place.
_BROKEN = re.compile(r"[-\xad\xac‐‑](?<=\w[-\xad\xac‐‑])\s*\n\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
# Characters and groups that scanning confuses, folded into one of them.
# One replacement after the other (a table for ``translate`` is looked up for every character of texts beyond ASCII).
_FOLD = [("0", "o"), ("1", "l"), ("i", "l"), ("|", "l"), ("!", "l"), ("5", "s"), ("8", "b"), ("6", "b"), ("@", "a"), ("+", "t")]
_GROUPS = [("rn", "m"), ("ll", "u"), ("cl", "d"), ("vv", "w"), ("c", "e")]


def fold_words(text: str) -> list[str]:
    text = _BROKEN.sub("", text.lower())
    for a, b in (*_FOLD, *_GROUPS):
        text = text.replace(a, b)
    return _WORD.findall(text)


class _Hashes(dict):
    """Word to the two bytes of its hash, cached."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = (zlib.crc32(word.encode()) & 0xFFFF).to_bytes(2, sys.byteorder)
        return h


_HASHES = _Hashes()


def sequences(records: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns and ``words``: two bytes for each word."""
    source = records.select(*keep, F.col(text).alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _HASHES.__getitem__
        for batch in batches:
            out = [b"".join(map(hashed, fold_words(t))) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


# The suffix array ------------------------------------------------------------------------------------------

#: k1 to k3 are the next twelve words, k4 hashes of what follows, spot is position << 32 | length of the record.
_SUFFIX = T.StructType([T.StructField(n, T.LongType()) for n in ("k1", "k2", "k3", "k4", "rec", "spot")])
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def laid_out(records: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of many records in one array, zeros between them, and where each begins and ends."""
    length = np.array([len(r) // 2 for r in records], np.int64)
    begin = np.cumsum(length + KEYED) - length - KEYED
    return np.frombuffer(bytes(2 * KEYED).join(records), np.uint16), begin, begin + length


def _within(size: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether each place is in one of the disjoint intervals."""
    step = np.zeros(size + 1, np.int8)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step[:-1], dtype=np.int8) > 0


def anchors(words: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
    """Every position of a short text; else those whose trigram hash is less than two neighbours' to each side, and the first.

    ``words`` is one text, or many as ``laid_out`` has them.
    """
    size = len(words)
    if begin is None or end is None:
        begin, end = np.zeros(1, np.int64), np.array([size])
    w = np.concatenate([words, np.zeros(2, np.uint16)]).astype(np.uint64)
    h = (w[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (w[2:] * np.uint64(0x165667B19E3779F9))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    top = np.iinfo(np.uint64).max
    p = np.full(size + 4, top)
    p[2:-2] = np.where(_within(size, begin, end), h, top)
    h = p[2:-2]
    ok = (h < p[1:-3]) & (h < p[:-4]) & (h <= p[3:-1]) & (h <= p[4:])
    long = end - begin >= DENSE
    ok[begin[long]] = True
    begin, end = begin[~long], end[~long]
    ok &= ~_within(size, begin, end)
    ok |= _within(size, begin, begin + np.maximum(end - begin - MIN_LCP_SHORT + 1, np.minimum(end - begin, 1)))
    return np.flatnonzero(ok)


def keys(words: np.ndarray, at: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
    """(suffixes, 4): the next twelve words packed so that order is word by word, and the hashes of what follows.

    ``end`` is where the text of each suffix ends, if ``words`` has many texts as ``laid_out`` has them.
    """
    n = len(words)
    end = np.full(len(at), n) if end is None else end
    padded = np.concatenate([words, np.zeros(KEYED, np.uint16)]).astype(np.int64)
    part = padded[at[:, None] + np.arange(KEYED)].reshape(len(at), 3, 4)
    packed = ((part[:, :, 0] - 0x8000) << 48) | part[:, :, 1] << 32 | part[:, :, 2] << 16 | part[:, :, 3]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _PRIME, np.uint64)]))
        inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((words.astype(np.uint64) + np.uint64(1)) * powers[:n])])
        begin = np.minimum(at + KEYED, end)
        k4 = np.zeros(len(at), np.uint64)
        for far in (*LEVELS, n):
            h = (sums[np.minimum(at + far, end)] - sums[begin]) * inverse[begin]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            k4 = k4 << np.uint64(16) | h >> np.uint64(48)
    return np.column_stack([packed, k4.view(np.int64)])


def suffix_rows(ids: np.ndarray, records: list[bytes]) -> np.ndarray:
    """The rows of ``_SUFFIX`` of many records, computed together."""
    words, begin, end = laid_out(records)
    at = anchors(words, begin, end)
    of = np.searchsorted(begin, at, "right") - 1
    return np.column_stack([keys(words, at, end[of]), ids[of], (at - begin[of]) << 32 | (end - begin)[of]])


def suffixes(reps: DataFrame) -> DataFrame:
    """One row for each suffix of ``reps`` (rec, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, records = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            # Groups of about so many words, so that memory stays small; only a longer record makes a larger group.
            group = np.cumsum([len(r) // 2 for r in records]) // GROUP_WORDS
            for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(records)]):
                rows = suffix_rows(ids[lo:hi], records[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(6)], names=_SUFFIX.names)

    return reps.select("rec", "words").mapInArrow(run, _SUFFIX)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading words of suffixes, row by row (exact up to twelve, then in steps of ``LEVELS``)."""
    n = np.zeros(len(a), np.int64)
    going = np.ones(len(a), bool)
    for i in range(3):
        x = a[:, i] ^ b[:, i]
        for shift in (48, 32, 16, 0):
            going &= (x >> shift) & 0xFFFF == 0
            n += going
    left = np.minimum((a[:, 5] & 0xFFFFFFFF) - (a[:, 5] >> 32), (b[:, 5] & 0xFFFFFFFF) - (b[:, 5] >> 32))
    x = a[:, 3] ^ b[:, 3]
    for shift, far in zip((48, 32, 16), LEVELS):
        going &= (x >> shift) & 0xFFFF == 0
        n = np.where(going, far, n)
    n = np.where(going & (x & 0xFFFF == 0), left, n)
    return np.minimum(n, left)  # beyond the end of a text nothing is shared


def adjacent(rows: np.ndarray) -> np.ndarray:
    """(a, b, at_a, at_b, length, n_a, n_b) of neighbours in sorted suffix rows that share a span; a < b."""
    a, b = rows[:-1], rows[1:]
    use = (a[:, 4] != b[:, 4]) & (a[:, 0] >> 16 == b[:, 0] >> 16)
    a, b = a[use], b[use]
    lcp = common_prefix(a, b)
    shorter = np.minimum(a[:, 5] & 0xFFFFFFFF, b[:, 5] & 0xFFFFFFFF)
    use = lcp >= np.where(shorter < DENSE, MIN_LCP_SHORT, MIN_LCP)
    a, b, lcp = a[use], b[use], lcp[use]
    swap = (a[:, 4] > b[:, 4])[:, None]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return np.column_stack([a[:, 4], b[:, 4], a[:, 5] >> 32, b[:, 5] >> 32, lcp, a[:, 5] & 0xFFFFFFFF, b[:, 5] & 0xFFFFFFFF])


_SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b", "at_a", "at_b", "length", "n_a", "n_b")])
_SPAN_OR_EDGE = T.StructType([*_SPAN.fields, T.StructField("edge", T.ArrayType(T.LongType()))])


def _span_batch(found: np.ndarray, edges: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate([found[:, i], np.zeros(len(edges), np.int64)])) for i in range(7)]
    edge = pa.array([None] * len(found) + [e.tolist() for e in edges], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([*columns, edge], names=_SPAN_OR_EDGE.names)


def spans(suffix_rows: DataFrame) -> DataFrame:
    """(a, b, at_a, at_b, length, n_a, n_b): spans that neighbours in the suffix array share."""
    order = _SUFFIX.names
    array = suffix_rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty((0, 6), np.int64)
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)])
            if not len(rows):
                continue
            first = [] if len(last) else [rows[0]]
            rows = np.concatenate([last, rows])
            last = rows[-1:]
            yield _span_batch(adjacent(rows), first)
        if len(last):
            yield _span_batch(np.empty((0, 7), np.int64), [last[0]])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.column(0).to_pylist()]
        if rows:
            found = adjacent(np.array(rows, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(7)], names=_SPAN.names)

    all_rows = materialize(array.mapInArrow(run, _SPAN_OR_EDGE))
    # The first and the last suffix of each partition: two rows a partition, whatever the number of suffixes.
    edges = all_rows.filter("edge IS NOT NULL").select("edge").coalesce(1).sortWithinPartitions(*[F.col("edge")[i] for i in range(6)])
    return all_rows.filter("edge IS NULL").select(*_SPAN.names).union(edges.mapInArrow(borders, _SPAN))


def _merged(spans_of: str, at: str) -> Column:
    """Words covered by the merged intervals of an array of spans."""
    begin = F.array_sort(F.transform(spans_of, lambda s: F.struct(s[at].alias("lo"), (s[at] + s["length"]).alias("hi"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("words"))
    return F.aggregate(
        begin,
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["hi"]).alias("end"),
            (acc["words"] + F.greatest(F.lit(0).cast("long"), s["hi"] - F.greatest(acc["end"], s["lo"]))).alias("words"),
        ),
        lambda acc: acc["words"],
    )


def nominated(span_rows: DataFrame, share: float = NOMINATE) -> DataFrame:
    """(a, b, spans) of records whose merged spans reach ``share`` of the shorter one."""
    pairs = span_rows.groupBy("a", "b").agg(
        F.collect_list(F.struct("at_a", "at_b", "length")).alias("spans"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")
    )
    covered = F.when(F.col("n_a") <= F.col("n_b"), _merged("spans", "at_a")).otherwise(_merged("spans", "at_b"))
    return pairs.filter(covered >= share * F.least("n_a", "n_b")).select("a", "b", "spans")


# Coverage ----------------------------------------------------------------------------------------------------


def extend(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray, least: float = 0.0) -> tuple[float, int, int]:
    """Coverage of the shorter sequence by merged spans on the diagonals (place in b - place in a): share, spans, longest span.

    Spans aren't told apart where the share is below ``least``: (share, 0, 0).
    """
    if len(a) > len(b):
        a, b, diagonals = b, a, -diagonals
    if len(a) < SPAN:
        same = np.array_equal(a, b)
        return float(same), int(same), len(a) * same
    near = np.unique((diagonals[:, None] + np.arange(-DRIFT, DRIFT + 1)).ravel())
    near = near[(near > -len(a)) & (near < len(b))]
    around = np.full(len(b) + 2 * len(a), -1, np.int32)  # what is no word, to either side of b
    around[len(a) : len(a) + len(b)] = b
    hit = around[near[:, None] + np.arange(len(a), 2 * len(a))] == a
    run = hit[:, :-2] & hit[:, 1:-1] & hit[:, 2:]
    begins = run.any(0)
    covered = np.zeros(len(a), bool)
    for k in range(SPAN):
        covered[k : len(a) - SPAN + 1 + k] |= begins
    share = np.count_nonzero(covered) / len(a)
    if share < least:
        return share, 0, 0
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    length = np.flatnonzero(edge < 0) - np.flatnonzero(edge > 0)
    return share, len(length), int(length.max(initial=0))


def links(candidates: DataFrame, reps: DataFrame, least: float = COVERED) -> DataFrame:
    """(a, b, covered, spans, longest) of the candidates that are the same page: the merged spans of the shorter record."""
    words = reps.select("rec", "words")
    both = candidates.join(words.withColumnsRenamed({"rec": "a", "words": "wa"}), "a").join(
        words.withColumnsRenamed({"rec": "b", "words": "wb"}), "b"
    )
    schema = T.StructType(
        [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("covered", T.DoubleType()), T.StructField("spans", T.IntegerType()), T.StructField("longest", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            done = [
                extend(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), flat[lo:hi], least)
                for x, y, lo, hi in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), ends, ends[1:])
            ]
            share = np.array([d[0] for d in done])
            found = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(share, pa.float64()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32())],
                names=schema.names,
            )
            yield found.filter(pa.array(share >= least))

    diagonals = F.array_distinct(F.transform("spans", lambda s: s["at_b"] - s["at_a"]))
    return both.select("a", "b", diagonals.alias("diagonals"), "wa", "wb").mapInArrow(run, schema)


def _records(gold: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, split), records (doc_id, source_dataset, words, class) and the links between classes."""
    members = gold.select("doc_id", F.lower(F.trim("_split")).alias("split")).filter("doc_id IS NOT NULL AND split IS NOT NULL").distinct()
    texts = spread(raw.select("doc_id", "source_dataset", "raw_text").filter("raw_text IS NOT NULL AND raw_text <> ''"))
    ids = broadcast_if_small(members.select("doc_id").distinct(), GOLD_BROADCAST_ROWS)
    # Repeated rows are equal after folding, so they fall together below and need no shuffle of texts here.
    records = sequences(texts.join(ids, "doc_id", "left_semi"), ["doc_id", "source_dataset"], "raw_text")
    records = materialize(records.filter(F.length("words") > 0).withColumn("class", F.xxhash64("words")))
    reps = records.groupBy("class").agg(F.first("words").alias("words")).withColumnRenamed("class", "rec")
    return members, records, links(nominated(spans(suffixes(reps))), reps)


def classes(gold: DataFrame, raw: DataFrame) -> DataFrame:
    """(doc_id, split, source_dataset, page): ``page`` is the same for records of the same page."""
    members, records, found = _records(gold, raw)
    pages = components(found)
    return (
        records.select("doc_id", "source_dataset", "class")
        .distinct()
        .join(pages.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("page", F.coalesce("component", "class"))
        .join(members, "doc_id")
        .select("doc_id", "split", "source_dataset", "page")
    )


def pages(gold: DataFrame, raw: DataFrame) -> DataFrame:
    """(doc_id, split, page, copies, train, held): one row for each record and split, with how many records have its page."""
    rows = materialize(classes(gold, raw).select("doc_id", "split", "page").distinct())
    counts = rows.groupBy("page").agg(
        F.countDistinct("doc_id").alias("copies"),
        F.countDistinct(F.when(F.col("split") == "train", F.col("doc_id"))).alias("train"),
        F.countDistinct(F.when(F.col("split").isin("val", "test"), F.col("doc_id"))).alias("held"),
    )
    return rows.join(counts, "page").select("doc_id", "split", "page", "copies", "train", "held")


def span_report(gold: DataFrame, raw: DataFrame) -> DataFrame:
    """(class_a, class_b, covered, spans, longest): the shared spans of linked texts, merged, for each pair of different texts."""
    found = _records(gold, raw)[2]
    return found.withColumnsRenamed({"a": "class_a", "b": "class_b"})


def found(gold: DataFrame, raw: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): a training record and an evaluation record of the same page, smaller id first."""
    rows = materialize(classes(gold, raw).select("doc_id", "split", "page").distinct())
    train = rows.filter("split = 'train'").select(F.col("doc_id").alias("x"), "page")
    held = rows.filter("split IN ('val', 'test')").select(F.col("doc_id").alias("y"), "page")
    pairs = train.join(held, "page").filter("x <> y")
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def report(gold: DataFrame, raw: DataFrame) -> DataFrame:
    """Per evaluation split and source: records, and those whose page is in the training split."""
    rows = materialize(classes(gold, raw))
    train = rows.filter("split = 'train'").select("page").distinct().withColumn("leaked", F.lit(1))
    held = rows.filter("split IN ('val', 'test')").join(train, "page", "left")
    source = F.lower(F.trim("source_dataset")).alias("source_dataset")
    return held.groupBy("split", source).agg(
        F.countDistinct("doc_id").alias("records"),
        F.countDistinct(F.when(F.col("leaked") == 1, F.col("doc_id"))).alias("overlapping"),
    )
