"""Filling fixed-capacity containers with items: pattern packing by non-negative least squares.

Only the histogram of lengths reaches the driver, whose size is the capacity, whatever the number of items. Patterns of a
few lengths that fill a container are fitted to it by non-negative least squares, rounded, and what remains is packed
best-fit over the histogram. The resulting plan (patterns with repeat counts) is broadcast; every item finds
its container from its rank among the items of its length.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drayline.plans.materialize import materialize

#: Where the public vocabulary lies (one token and its rank in each line); a parameter of the tokenising functions.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary splits text.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PATTERNS_PER_LENGTH = 12
SWEEPS = 60
RANK_ROWS = 500_000
_SHIFT = 40


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` of every document, each once; null and empty texts have no tokens. Whole texts are read.

    The vocabulary is read where the query is started, and shipped to the executors.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    shipped = os.path.basename(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(SparkFiles.get(shipped), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tokenizer = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch["text"]]})

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return docs.mapInPandas(count, "doc_id long, n_tokens long").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def enumerate_patterns(histogram: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths that fill the capacity, or nearly so, from lengths that occur."""
    present = np.flatnonzero(histogram > 0)
    if not len(present):
        return []
    filler = np.zeros(capacity + 1, np.int64)
    filler[present] = present
    filler = np.maximum.accumulate(filler)  # the longest occurring length that fits into a space
    found: set[tuple[int, ...]] = set()
    for first in present[::-1].tolist():
        space = capacity - first
        found.add((first,))
        # partners from those that close the container at once to ones that leave room for more
        partners = {int(filler[space])} | {int(filler[int(space * k / PATTERNS_PER_LENGTH)]) for k in range(1, PATTERNS_PER_LENGTH)}
        for second in partners - {0}:
            left = space - second
            third = int(filler[left])
            found.add(tuple(sorted((first, second), reverse=True)))
            if third:
                found.add(tuple(sorted((first, second, third), reverse=True)))
                fourth = int(filler[left - third])
                if fourth:
                    found.add(tuple(sorted((first, second, third, fourth), reverse=True)))
                half = int(filler[left // 2])
                if half and int(filler[left - half]):
                    found.add(tuple(sorted((first, second, half, int(filler[left - half])), reverse=True)))
    return [p for p in found if sum(p) <= capacity]


def fit_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """Repeat counts of patterns: non-negative least squares on the histogram by cyclic coordinate descent."""
    columns = []
    for p in patterns:
        lengths, times = np.unique(p, return_counts=True)
        columns.append((lengths, times.astype(float), float((times**2).sum())))
    residual, x = histogram.astype(float).copy(), np.zeros(len(patterns))
    for _ in range(SWEEPS):
        moved = 0.0
        for j, (lengths, times, norm) in enumerate(columns):
            fresh = max(0.0, x[j] + float(times @ residual[lengths]) / norm)
            step = fresh - x[j]
            if step:
                residual[lengths] -= step * times
                x[j] = fresh
                moved = max(moved, abs(step))
        if moved < 1e-3 * max(1.0, float(histogram.max())):
            break
    return x


def plan_packing(histogram: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: times}) of every pattern used; together they take exactly the items of the histogram."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[int, dict[int, int]]] = []

    def use(p: tuple[int, ...], repeats: int) -> None:
        lengths, times = np.unique(p, return_counts=True)
        repeats = min(repeats, int((left[lengths] // times).min()))
        if repeats > 0:
            left[lengths] -= repeats * times
            plan.append((repeats, dict(zip(lengths.tolist(), times.tolist(), strict=True))))

    # only patterns without unused space are fixed by the fit; the others' items are better off with the residual
    tight = [p for p in enumerate_patterns(histogram, capacity) if sum(p) == capacity]
    counts = fit_counts(tight, histogram) if tight else np.zeros(0)
    for j in np.argsort(-counts, kind="stable"):
        use(tight[j], round(float(counts[j])))

    # best fit, longest first, over groups of equally filled containers
    spaces: dict[int, list[list]] = defaultdict(list)  # unused space -> [number of containers, content]
    open_spaces = np.zeros(capacity + 1, bool)

    def put(space: int, n: int, content: dict[int, int]) -> None:
        if n > 0:
            spaces[space].append([n, content])
            open_spaces[space] = True

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fitting = np.flatnonzero(open_spaces[length:])
            if len(fitting):
                space = length + int(fitting[0])
                group = spaces[space][-1]
                each = space // length
                if n >= each and group[0] > 0:
                    k = min(group[0], n // each)
                else:
                    k, each = 1, n
                group[0] -= k
                if not group[0]:
                    spaces[space].pop()
                    open_spaces[space] = bool(spaces[space])
                put(space - each * length, k, {**group[1], length: group[1].get(length, 0) + each})
                n -= k * each
            else:
                each = capacity // length
                full, rest = divmod(n, each)
                put(capacity - each * length, full, {length: each})
                put(capacity - rest * length, 1 if rest else 0, {length: rest})
                n = 0
    plan += [(n, content) for groups in spaces.values() for n, content in groups if n]
    return plan


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``(doc_id, piece, first_token, n_tokens, container_id)`` of every item's pieces.

    ``items`` has ``doc_id`` and ``n_tokens``. An item up to the capacity stays whole (piece 0). A longer one is cut into pieces
    of exactly the capacity and a rest; only such items are cut. Items without tokens (or null) need no room: their
    ``container_id`` is null. Containers are numbered from 0. Repeated rows are items of their own. An empty table gives no
    rows; other columns are not read.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    c = F.lit(capacity).cast("long")
    known = items.select("doc_id", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("all"))
    pieces = known.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("all") / c) - 1, F.lit(0).cast("long")))))
    pieces = materialize(pieces.select("doc_id", "piece", (F.col("piece") * c).alias("first_token"), F.least(c, F.col("all") - F.col("piece") * c).alias("n_tokens")))
    sized = pieces.where("n_tokens > 0")
    counted = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counted:
        histogram[r["n_tokens"]] = r["n"]

    key, base, times, number = [], [], [], 0
    begun: dict[int, int] = defaultdict(int)
    for repeats, content in plan_packing(histogram, capacity):
        for length, each in content.items():
            key.append((length << _SHIFT) + begun[length])
            base.append(number)
            times.append(each)
            begun[length] += repeats * each
        number += repeats
    order = np.argsort(np.array(key, np.int64), kind="stable")
    table = tuple(np.array(x, np.int64)[order] for x in (key, base, times))

    # the rank of an item among those of its length: buckets of bounded size, then rows within a bucket
    buckets = max(1, int(histogram.max()) // RANK_ROWS)
    spread = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    if buckets > 1:
        offsets = spread.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n"))
        before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = offsets.select("n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        spread = spread.join(offsets, ["n_tokens", "bucket"])
    else:
        spread = spread.withColumn("offset", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")) - 1 + F.col("offset")
    ranked = spread.select("doc_id", "piece", "first_token", "n_tokens", rank.cast("long").alias("rank"))
    shared = items.sparkSession.sparkContext.broadcast(table)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, bases, each = shared.value
        for b in batches:
            at = (b["n_tokens"].to_numpy() << _SHIFT) + b["rank"].to_numpy()
            k = np.searchsorted(starts, at, "right") - 1
            yield b[["doc_id", "piece", "first_token", "n_tokens"]].assign(container_id=bases[k] + (at - starts[k]) // each[k])

    schema = "doc_id long, piece long, first_token long, n_tokens long, container_id long"
    empty = pieces.where("n_tokens <= 0").select("doc_id", "piece", "first_token", "n_tokens", F.lit(None).cast("long").alias("container_id"))
    return ranked.mapInPandas(assign, schema).unionByName(empty)


def packing_quality(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, pieces, tokens, overfull containers, and the part of the room that stays unused."""
    each = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    return each.agg(
        F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.count_if(F.col("t") > capacity).alias("overfull"),
        F.round(1 - F.sum("t") / (F.count("*") * F.lit(capacity)), 6).alias("unused"),
    )
