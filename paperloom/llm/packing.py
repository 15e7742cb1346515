"""Filling containers of fixed capacity with texts (problem 7).

Planning works on the histogram of sizes, never on documents. A text larger than the capacity becomes
full pieces, each alone in a container, and one remainder; so at most ``capacity`` different sizes are
left, however many documents there are. Best fit in order of falling size runs over the counts: groups of
equally filled containers take items together. The plan says, for each size, which ranks of items go to
which containers; documents get a rank within their size and look their container up.

The plan is broadcast; its rows are bounded by the capacity (a group is split only when a size runs out,
so there are at most as many groups as sizes, and a container holds at most sqrt(2 x capacity) different
sizes), not by the data.

Ranks within a size don't gather the size in one task: a size is split into as many parts as its count calls for by a hash of
the key, parts are counted first, and each part is numbered from the sum of the parts before it.

Defined results: null and empty texts have size 0, take no room and are dealt over the containers in
turn; repeated rows are items of their own; ties in size are broken by salt and key; capacities below 1
or null yield no rows; every item appears in exactly one container unless it was split.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import bpe
from paperloom.session import materialize

#: A size is split into parts of about so many documents, at least ``LEAST_SALTS``.
ROWS_A_SALT = 1 << 18
LEAST_SALTS = 64


def plan(sizes: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], int]:
    """Best fit over counts.

    ``sizes``: items of each size in 1..capacity. Returns, for each size, runs (first rank, first
    container, items a container, containers, used before) in order of rank, and the number of containers.
    """
    # Open groups by room left: containers first..first+n-1 are filled alike.
    open_groups: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    made = 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_groups:
                open_groups[room] = []
                bisect.insort(rooms, room)
            open_groups[room].append((first, n))

    for size in sorted(sizes, reverse=True):
        left, rank, mine = sizes[size], 0, runs.setdefault(size, [])

        def put(first: int, n: int, each: int, used: int, size: int = size, mine: list = mine) -> None:
            nonlocal rank, left
            mine.append((rank, first, each, n, used))
            rank += n * each
            left -= n * each
            add(capacity - used - each * size, first, n)

        while left:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                n = left // each
                if n:
                    put(made, n, each, 0)
                    made += n
                if left:
                    made += 1
                    put(made - 1, 1, left, 0)
                break
            room = rooms[i]
            first, n = open_groups[room].pop()
            if not open_groups[room]:
                del open_groups[room]
                rooms.pop(i)
            each = room // size
            take = min(n, left // each)
            if take:
                put(first, take, each, capacity - room)
            if take < n and left:  # fewer items than fit into one more container
                put(first + take, 1, left, capacity - room)
                take += 1
            add(room, first + take, n - take)
    return runs, made


def _ranked(items: DataFrame, salts: int) -> DataFrame:
    """``rank`` of each row within (spec, size), without one task for a frequent size."""
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    part = Window.partitionBy("capacity", "size", "salt").orderBy("doc_id", "piece")
    before = (
        salted.groupBy("capacity", "size", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("capacity", "size").orderBy("salt")) - F.col("n"))
        .drop("n")
    )
    numbered = salted.withColumn("at", F.row_number().over(part) - 1)
    return numbered.join(before, ["capacity", "size", "salt"]).withColumn("rank", F.col("before") + F.col("at"))


def pack(docs: DataFrame, specs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece: spec_name, capacity_tokens, doc_id, piece, n_tokens, container_id, token_offset.

    ``docs``: doc_id, text. ``specs``: spec_name, capacity_tokens (a few rows; it is collected).
    ``piece`` counts from 0 and ``n_tokens`` is the piece's size; ``token_offset`` is its place within the
    container, so that pieces of one container don't overlap.
    """
    spark = docs.sparkSession
    capacities = {
        r.spec_name: r.capacity_tokens
        for r in specs.select("spec_name", "capacity_tokens").distinct().collect()
        if r.spec_name is not None and r.capacity_tokens and r.capacity_tokens > 0
    }
    tokens = materialize(bpe.encode(docs, vocabulary=vocabulary, output="count"))
    wanted = sorted(set(capacities.values()))
    each = F.explode(F.array(*[F.lit(int(c)) for c in wanted])) if wanted else F.explode(F.array().cast("array<int>"))
    sized = (
        tokens.select("doc_id", "n_tokens", each.alias("capacity"))
        .withColumn("full", (F.col("n_tokens") / F.col("capacity")).cast("long"))
        .withColumn("size", (F.col("n_tokens") - F.col("full") * F.col("capacity")).cast("int"))
        .drop("n_tokens")
    )
    # The histogram has at most the sum of the capacities as rows.
    histogram: dict[int, dict[int, int]] = {c: {} for c in wanted}
    full: dict[int, int] = dict.fromkeys(wanted, 0)
    for r in sized.groupBy("capacity", "size").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect():
        histogram[r.capacity][r.size] = r.n
        full[r.capacity] += r.full
    most = max((n for sizes in histogram.values() for n in sizes.values()), default=0)
    salts = max(LEAST_SALTS, -(-most // ROWS_A_SALT))
    tables, made = {}, {}
    for c in wanted:
        runs, made[c] = plan({s: n for s, n in histogram[c].items() if s}, c)
        for s, found in runs.items():
            tables[c, s] = np.array(found, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((tables, made))

    # An exact multiple of the capacity has no remainder; a text without tokens is one item of size 0.
    remainders = sized.filter((F.col("size") > 0) | (F.col("full") == 0)).withColumn("piece", F.col("full"))
    ranked = _ranked(remainders, salts).select("doc_id", "capacity", "piece", "size", "rank")
    schema = T.StructType(
        [
            ranked.schema["doc_id"],
            T.StructField("capacity", T.IntegerType()),
            T.StructField("piece", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("container_id", T.LongType()),
            T.StructField("token_offset", T.LongType()),
        ]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, made = shared.value
        for batch in batches:
            capacity, piece, size, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
            box, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.lexsort((size, capacity))
            key = np.flatnonzero(np.diff(capacity[order], prepend=-1) | np.diff(size[order], prepend=-1))
            for lo, hi in zip(key, np.append(key[1:], len(order))):
                rows = order[lo:hi]
                c, s = int(capacity[rows[0]]), int(size[rows[0]])
                if s == 0:
                    box[rows] = rank[rows] % max(made[c], 1)
                    continue
                table = runs[c, s]
                run = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1]
                within = rank[rows] - run[:, 0]
                box[rows] = run[:, 1] + within // run[:, 2]
                at[rows] = run[:, 4] + within % run[:, 2] * s
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(size.astype(np.int64)), pa.array(box), pa.array(at)],
                names=schema.names,
            )

    placed = ranked.mapInArrow(place, schema)
    # Full pieces are numbered after the planned containers; salted prefix sums as for the ranks.
    big = sized.filter(F.col("full") > 0).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    before = (
        big.groupBy("capacity", "salt")
        .agg(F.sum("full").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("capacity").orderBy("salt")) - F.col("n"))
        .drop("n")
    )
    start = F.create_map(*[F.lit(int(x)) for c in wanted for x in (c, made[c])]) if wanted else F.create_map().cast("map<int,int>")
    order = Window.partitionBy("capacity", "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = (
        big.withColumn("mine", F.sum("full").over(order) - F.col("full"))
        .join(before, ["capacity", "salt"])
        .withColumn("first", start[F.col("capacity")].cast("long") + F.col("before") + F.col("mine"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
        .select(
            "doc_id",
            "capacity",
            "piece",
            F.col("capacity").cast("long").alias("n_tokens"),
            (F.col("first") + F.col("piece")).alias("container_id"),
            F.lit(0).cast("long").alias("token_offset"),
        )
    )
    named = F.explode(F.from_json(F.lit("[]"), "array<string>"))
    if capacities:
        by_capacity: dict[int, list[str]] = {}
        for name, c in sorted(capacities.items()):
            by_capacity.setdefault(c, []).append(name)
        entries = [x for c, names in by_capacity.items() for x in (F.lit(int(c)), F.array(*[F.lit(n) for n in names]))]
        named = F.explode(F.create_map(*entries)[F.col("capacity")])
    return (
        placed.unionByName(whole)
        .withColumn("spec_name", named)
        .select("spec_name", F.col("capacity").alias("capacity_tokens"), "doc_id", "piece", "n_tokens", "container_id", "token_offset")
    )


def fill(assignments: DataFrame) -> DataFrame:
    """Per container: items, used tokens and unused share."""
    return (
        assignments.groupBy("spec_name", "capacity_tokens", "container_id")
        .agg(F.count("*").alias("items"), F.sum("n_tokens").alias("used"))
        .withColumn("unused_share", F.round(1 - F.col("used") / F.col("capacity_tokens"), 4))
    )
