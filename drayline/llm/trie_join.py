"""Joining a set of spellings with itself within a bounded edit distance, by sharded tries; no pair within the bound is lost.

A scope with few spellings is one shard. Larger scopes are sharded by what two neighbours surely share. At one edit, one of
them less a letter is the other, or the other less a letter. At two edits, take a cut: if at most one edit touches what is before
it, the beginnings up to the cut share all but one letter; otherwise both edits are spent before it, and the endings
are equal from one letter behind the cut on (where a swap may stand on the cut itself). The latter are cut again further ahead, so that every
shard's key has several letters whatever the spellings; at the last cut the equal endings are the key. Cuts depend on the length of the
shorter spelling, so a spelling has keys for each length that the shorter one can have. Spellings of one shard form a
trie, through which a Levenshtein automaton (its state is a row of distances, swapped neighbours counting as one edit) enumerates
the neighbours of each looked-up spelling; many shards are searched at once. Shards that are too large are split into blocks of a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayline.plans.materialize import materialize, release
from drayline.plans.skew import parallelism_of

#: Scopes with at most so many spellings are one shard; larger shards are split into blocks of so many. Neither changes what is found.
SCOPE_WORDS = 150
BLOCK_ROWS = 4000
#: Spellings from this length on may be two edits off.
LONG = 8
#: From so many combinations on, shards are searched for many words at once, with at most so many combinations at a time.
BATCH_FROM, BATCH_PAIRS = 400, 400_000
#: Cuts for two edits, by the least length of the shorter spelling. Scopes with at most so many combinations do with fewer, so with fewer keys.
CUTS = {8: (5, 3, 2), 10: (7, 5, 3), 12: (8, 5, 3), 16: (10, 6, 3), 24: (15, 9, 4)}
FEW_CUTS, FEW_PAIRS = {k: v for k, v in CUTS.items() if k != 10}, 20_000**2
_END = ""


def bound(length: int) -> int:
    """Edits allowed in a spelling of this length."""
    return 2 if length >= LONG else 1 if length >= 4 else 0


def neighbours(trie: dict, word: str, most: int) -> list[tuple[str, int]]:
    """Words of the trie within ``most`` edits, with their distances."""
    found: list[tuple[str, int]] = []
    first = list(range(len(word) + 1))
    if first[-1] <= most and _END in trie:
        found.append((trie[_END], first[-1]))
    stack = [(trie, "", first, None, "")]
    while stack:
        node, _, row, before, last = stack.pop()
        for letter, child in node.items():
            if letter == _END:
                continue
            fresh = [row[0] + 1]
            best = fresh[0]
            for j in range(1, len(word) + 1):
                w = word[j - 1]
                cost = row[j - 1] if w == letter else 1 + min(row[j - 1], row[j], fresh[j - 1])
                if before is not None and j > 1 and w == last and word[j - 2] == letter and before[j - 2] + 1 < cost:
                    cost = before[j - 2] + 1
                fresh.append(cost)
                if cost < best:
                    best = cost
            if best <= most:
                if fresh[-1] <= most and _END in child:
                    found.append((child[_END], fresh[-1]))
                stack.append((child, letter, fresh, row, letter))
            elif before is None or min(row) <= most - 1:
                # a swap may still repair this state
                stack.append((child, letter, fresh, row, letter))
    return found


def _codes(words: list[str], width: int) -> np.ndarray:
    """Letters of the words as numbers, filled up with 0."""
    if not width:
        return np.zeros((len(words), 0), np.int64)
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), width).astype(np.int64)


def neighbours_of_all(indexed: list[str], asked: list[str], most: np.ndarray, root: np.ndarray | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`neighbours` finds, for all asked words at once: their numbers, those of the found words, the distances.

    The trie is walked level by level; the states of all automata at all nodes of a level are rows of one array. With
    ``root``, a number for each indexed word, there is a trie for each number, and ``start`` says in which one a word is asked.
    """
    depth, width = max(map(len, indexed)), max(map(len, asked))
    root = np.zeros(len(indexed), np.int64) if root is None else root
    order = np.lexsort((np.array(indexed), root))
    tree, length = _codes([indexed[k] for k in order], depth + 1), np.array([len(indexed[k]) for k in order])
    text, goal = _codes(asked, width), np.array([len(q) for q in asked])
    # of each level the node that every word passes; words of one node stand together
    node_of = root[order]
    columns = np.arange(width + 1)
    ask, node = np.arange(len(asked)), np.zeros(len(asked), np.int64) if start is None else start
    row = np.broadcast_to(columns, (len(asked), width + 1)).astype(np.int16)
    before, last = None, None
    outside = columns[None, :] > goal[:, None]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def collect(level: int) -> None:
        ends = np.flatnonzero(length == level)
        if not len(ends) or not len(ask):
            return
        word_at = np.full(int(node_of.max()) + 1, -1)
        word_at[node_of[ends]] = ends
        d = row[np.arange(len(ask)), goal[ask]]
        hit = (word_at[node] >= 0) & (d <= most[ask])
        found.append((ask[hit], order[word_at[node[hit]]], d[hit].astype(np.int64)))

    collect(0)
    for level in range(depth):
        alive = length > level
        # children of this level's nodes, in the order of the sorted words
        parent, letter = node_of, np.where(alive, tree[:, level], -1)
        first = np.ones(len(indexed), bool)
        first[1:] = (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
        child = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        use = alive[starts]
        c_parent, c_letter, c_id = parent[starts][use], letter[starts][use], child[starts][use]
        low, high = np.searchsorted(c_parent, node, "left"), np.searchsorted(c_parent, node, "right")
        n = high - low
        state = np.repeat(np.arange(len(ask)), n)
        pick = np.repeat(low - np.append(0, np.cumsum(n))[:-1], n) + np.arange(int(n.sum()))
        node_of = child
        if not len(state):
            ask = ask[:0]
            break
        here, old, who = c_letter[pick], row[state], ask[state]
        fresh = np.empty_like(old)
        fresh[:, 0] = old[:, 0] + 1
        for j in range(1, width + 1):
            cost = np.minimum(old[:, j] + 1, fresh[:, j - 1] + 1)
            cost = np.minimum(cost, old[:, j - 1] + (text[who, j - 1] != here))
            if before is not None and j > 1:
                swapped = (text[who, j - 1] == last[state]) & (text[who, j - 2] == here)
                cost = np.where(swapped, np.minimum(cost, before[state, j - 2] + 1), cost)
            fresh[:, j] = cost
        past = outside[who]
        keep = (np.where(past, 99, fresh).min(1) <= most[who]) | (np.where(past, 99, old).min(1) <= most[who] - 1)
        ask, node, row, before, last = who[keep], c_id[pick][keep], fresh[keep], old[keep], here[keep]
        collect(level + 1)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _less_one(codes: np.ndarray, cut: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words' first ``cut`` letters less one of them, each one in turn; and which of them aren't there before."""
    with_r, before_r = codes[:, :cut] * _FACTORS[1 : cut + 1], codes[:, :cut] * _FACTORS[:cut]
    ahead = np.cumsum(with_r, 1) - with_r
    behind = before_r.sum(1)[:, None] - np.cumsum(before_r, 1)
    for k in range(cut):
        yield ahead[:, k] + behind[:, k], np.ones(len(codes), bool) if k == 0 else codes[:, k] != codes[:, k - 1]


def _keys(words: np.ndarray, scopes: np.ndarray, cuts: dict[int, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Shards of words: numbers of the words, with the keys; ``scopes`` has a hash of each word's scope."""
    numbers, keys = [], []
    lengths = np.char.str_len(words)
    for n in np.unique(lengths):
        n = int(n)
        if n < 4:
            continue
        own = np.flatnonzero(lengths == n)
        codes = np.ascontiguousarray(words[own].astype(f"<U{n}")).view(np.uint32).reshape(len(own), n).astype(np.uint64)
        if n + 1 > len(_FACTORS):
            _grow(n + 1)

        def add(kind: int, hashes: np.ndarray, use: np.ndarray | None = None) -> None:
            # the kind and the scope go in by a mix that doesn't add up with the letters' sums
            mixed = hashes ^ (scopes[own] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0x632BE59BD9B4E019 % 2**64))
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
            numbers.append(own if use is None else own[use])
            keys.append(mixed if use is None else mixed[use])

        if n <= LONG:
            # shorter ones less nothing, for those that have a letter more
            if n < LONG:
                add(n, (codes * _FACTORS[1 : n + 1]).sum(1))
            for hashes, use in _less_one(codes, n):
                add(n - 1, hashes, use)
        # the cuts that hold for any length that the shorter of two spellings can have
        for least in {max(c for c in cuts if c <= q) for q in range(max(LONG, n - 2), n + 1) if n >= LONG}:
            ending = 0
            for cut in cuts[least]:
                tail = (codes[:, n - ending :] * _TAIL[:ending]).sum(1) if ending else np.uint64(0)
                for hashes, use in _less_one(codes, cut):
                    add(least * 1000 + cut, hashes + tail, use)
                ending = least - 1 - cut
            add(least * 1000, (codes[:, n - ending :] * _TAIL[:ending]).sum(1))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(numbers), np.concatenate(keys).view(np.int64)


def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


_FACTORS, _TAIL = _factors(64, 1), _factors(max(CUTS), 2)


def _grow(n: int) -> None:
    """More of the same factors, for longer words."""
    global _FACTORS
    _FACTORS = _factors(2 * n, 1)


_ENTRY = "shard long, scope string, word string, indexed boolean, asked boolean"
_FOUND = "scope string, a string, b string, d int, shard long, indexed boolean, asked boolean"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``scope``, ``word``, ``indexed``, ``asked``, ``hash`` (of the scope) and ``level`` (of its size), once for each shard."""
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            if not part.num_rows:
                continue
            words, level, scopes = np.array(part["word"].to_pylist()), part["level"].to_numpy(), part["hash"].to_numpy().view(np.uint64)
            whole, long = np.flatnonzero(level == 0), np.char.str_len(words) > 32
            found = [(whole, scopes[whole].view(np.int64))]
            for n, cuts in ((1, FEW_CUTS), (2, CUTS)):
                # a very long word would make the array of all others as wide
                for some in (np.flatnonzero((level == n) & ~long), np.flatnonzero((level == n) & long)):
                    if len(some):
                        numbers, keys = _keys(words[some], scopes[some], cuts)
                        found.append((some[numbers], keys))
            rows, keys = (np.concatenate(x) for x in zip(*found, strict=True))
            taken = part.select(["scope", "word", "indexed", "asked"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *taken.columns], names=["shard", "scope", "word", "indexed", "asked"])


def _pairs(words: list[str], root: np.ndarray, stands: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of asked and found words of one root, and the distances."""
    length = np.array([len(w) for w in words])
    bounds = np.where(length >= LONG, 2, np.where(length >= 4, 1, 0))
    index, ask = np.flatnonzero(stands), np.flatnonzero(wanted)
    if len(index) * len(ask) < BATCH_FROM:
        tries: dict[int, dict] = {}
        for k in index.tolist():
            node = tries.setdefault(int(root[k]), {})
            for letter in words[k]:
                node = node.setdefault(letter, {})
            node[_END] = k
        got = [(q, k, d) for q in ask.tolist() for k, d in neighbours(tries.get(int(root[q]), {}), words[q], int(bounds[q]))]
        found = np.array(got, np.int64).reshape(-1, 3)
        i, j, d = found[:, 0], found[:, 1], found[:, 2]
        keep = (length[i] > 0) & (d > 0) & (d <= bounds[j])
        yield i[keep], j[keep], d[keep]
        return
    each = np.bincount(root[index], minlength=int(root.max()) + 1)
    # words of about the same length together, since the longest one makes the arrays wide
    for low, high in ((0, 10), (10, 14), (14, 24), (24, 2**31)):
        some = ask[(length[ask] > low) & (length[ask] <= high)]
        load = np.cumsum(each[root[some]]) // BATCH_PAIRS
        for part in np.split(some, np.flatnonzero(np.diff(load)) + 1) if len(some) else []:
            there = np.zeros(len(each), bool)
            there[root[part]] = True
            near = index[there[root[index]] & (length[index] >= low - 1) & (length[index] <= high + 2)]
            if not len(near):
                continue
            i, j, d = neighbours_of_all([words[k] for k in near], [words[k] for k in part], bounds[part], root[near], root[part])
            i, j = part[i], near[j]
            keep = (d > 0) & (d <= bounds[j])
            yield i[keep], j[keep], d[keep]


def _searched(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Search of rows sorted by shard; rows of shards with more than ``most`` rows (0: of none) come back with ``d`` -1."""
    schema = pa.schema([("scope", pa.string()), ("a", pa.string()), ("b", pa.string()), ("d", pa.int32()), ("shard", pa.int64()), ("indexed", pa.bool_()), ("asked", pa.bool_())])

    def back(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        columns = [rows["scope"], rows["word"], pa.nulls(n, pa.string()), pa.array(np.full(n, -1, np.int32)), rows["shard"], rows["indexed"], rows["asked"]]
        yield from pa.Table.from_arrays(columns, schema=schema).to_batches()

    def close(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        shard, stands, wanted = (rows[c].to_numpy() for c in ("shard", "indexed", "asked"))
        if not len(shard):
            return
        first = np.append(True, shard[1:] != shard[:-1])
        starts, root = np.flatnonzero(first), np.cumsum(first) - 1
        size = np.diff(np.append(starts, len(shard)))
        use = (size > 1) & (np.add.reduceat(stands.astype(np.int64), starts) > 0) & (np.add.reduceat(wanted.astype(np.int64), starts) > 0)
        large = use & (size > most) if most else np.zeros(len(use), bool)
        if large.any():
            yield from back(rows.take(pa.array(np.flatnonzero(large[root]))))
            use &= ~large
        rows = rows.take(pa.array(np.flatnonzero(use[root])))
        if not rows.num_rows:
            return
        root, stands, wanted = (x[use[root]] for x in (root, stands, wanted))
        words, scopes = rows["word"].to_pylist(), rows["scope"].to_pylist()
        found = {(scopes[i], words[i], words[j], d) for found in _pairs(words, root, stands, wanted) for i, j, d in zip(*(x.tolist() for x in found), strict=True) if scopes[i] == scopes[j]}
        if found:
            n = len(found)
            columns = [pa.array(x) for x in zip(*found, strict=True)]
            columns[3] = columns[3].cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.bool_())], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last shard of a batch may go on in the next one; from a large one no more than a batch is held
        held: list[pa.RecordBatch] = []
        count, over = 0, None
        for batch in batches:
            if over is not None:
                same = int(np.count_nonzero(batch["shard"].to_numpy() == over))
                if same:
                    yield from back(pa.Table.from_batches([batch.slice(0, same)]))
                if same == batch.num_rows:
                    continue
                batch, over = batch.slice(same), None
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            shard = batch["shard"].to_numpy()
            last = int(np.searchsorted(shard, shard[-1]))
            if last or held[0]["shard"][0].as_py() != shard[-1]:
                rows = pa.Table.from_batches(held)
                whole = count - batch.num_rows + last
                yield from close(rows.slice(0, whole).combine_chunks())
                held = [batch.slice(last)]
                count = batch.num_rows - last
            if most and count > most:
                yield from back(pa.Table.from_batches(held))
                over, held, count = int(shard[-1]), [], 0
        if held:
            yield from close(pa.Table.from_batches(held).combine_chunks())

    return search


def _entries(words: DataFrame, asked: DataFrame | None) -> DataFrame:
    """``(scope, word, indexed, asked, level)``: every spelling that stands in a trie or is looked up; its scope is whole (0), small (1) or large."""
    usable = "scope is not null and length(word) >= 4"
    index = words.select("scope", "word", F.lit(True).alias("indexed"), F.lit(asked is None).alias("asked")).where(usable)
    every = index if asked is None else index.unionByName(asked.select("scope", "word", F.lit(False).alias("indexed"), F.lit(True).alias("asked")).where(usable))
    sizes = every.groupBy("scope").agg(F.count_if("indexed").alias("i"), F.count_if("asked").alias("q"))
    level = F.when(F.greatest("i", "q") <= SCOPE_WORDS, 0).when(F.col("i") * F.col("q") <= FEW_PAIRS, 1).otherwise(2)
    # nothing is found where one of the two is missing
    return every.join(sizes.where("i > 0 and q > 0").select("scope", level.alias("level")), "scope")


def trie_join(words: DataFrame, asked: DataFrame | None = None, more: Sequence[tuple[DataFrame, DataFrame]] = ()) -> DataFrame:
    """``(scope, a, b, d)``: different spellings of one scope within the bounded distance, all of them.

    ``words`` holds ``scope`` and ``word``, each pair once. ``asked``, of the same form, says for which spellings neighbours
    ``b`` among ``words`` are wanted; without it they are for all ``words``, and the result has both directions. ``more``
    has further pairs like ``words`` and ``asked``, of other scopes, searched in the same pass. Nulls and spellings too short
    for any edit have no neighbours. An empty table gives no rows; other columns are not read.
    """
    entries = _entries(words, asked)
    for other, wanted in more:
        entries = entries.unionByName(_entries(other, wanted))
    tasks = parallelism_of(entries) * 2
    placed = entries.withColumn("hash", F.xxhash64("scope")).mapInArrow(_placed, _ENTRY)
    raw = materialize(placed.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_searched(2 * BLOCK_ROWS), _FOUND))
    large = raw.where("d < 0").select("shard", "scope", F.col("a").alias("word"), "indexed", "asked")
    pairs = raw.where("d >= 0").select("scope", "a", "b", "d")
    if not large.isEmpty():
        rows, columns = (F.ceil(F.count_if(c) / BLOCK_ROWS).cast("int") for c in ("indexed", "asked"))
        split = large.join(large.groupBy("shard").agg(rows.alias("rows"), columns.alias("columns")).where("rows > 0 and columns > 0"), "shard")
        own = F.xxhash64("word")

        def blocks(fixed: str, other: str, down: bool) -> Column:
            mine = F.pmod(own, F.col(fixed).cast("long")).cast("int")
            return F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda k: mine * F.col("columns") + k if down else k * F.col("columns") + mine)

        # an indexed spelling stands in one row of blocks, a looked-up one in one column; one that is both is two here
        index = split.where("indexed").withColumns({"asked": F.lit(False), "block": F.explode(blocks("rows", "columns", True))})
        look = split.where("asked").withColumns({"indexed": F.lit(False), "block": F.explode(blocks("columns", "rows", False))})
        parts = index.unionByName(look).select(F.xxhash64("shard", "block").alias("shard"), "scope", "word", "indexed", "asked")
        more_pairs = parts.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_searched(0), _FOUND)
        pairs = pairs.unionByName(more_pairs.select("scope", "a", "b", "d"))
    found = materialize(pairs.groupBy("scope", "a", "b").agg(F.min("d").alias("d")))
    release(raw)
    return found
