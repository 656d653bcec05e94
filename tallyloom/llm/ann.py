"""Approximate nearest neighbours by a hash-prefix forest.

A tree hashes every vector to a long bit string, the signs of its projections
on random directions of the tree, and keeps the strings as one sorted array,
so that all strings with a common prefix are a range. A query descends each
tree to the longest prefix that it shares with anything there; then all trees
ascend together, a bit at a time, until their ranges hold enough candidates.
Candidates are ranked by exact cosine in double precision.

The forest is sharded: vectors are dealt evenly into shards of bounded size,
each with its own trees, stored as one row of arrays in the shared folder.
Queries are packed into blocks of bounded size on the executors. One block is
broadcast and meets each shard in a task of its own; several blocks meet the
shards in a join on block and group of shards, so that a task has some shards
and one block. A task answers with the best few of all its shards, and the
best over all tasks are kept. Within a shard equal vectors are one entry with
its smallest ids, so many copies of one vector neither crowd out others nor
hide the smallest id.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, take no part; vectors of another length
than the query's aren't its candidates; a repeated id is one candidate, by
the nearest of its vectors, never for itself; fewer candidates than
asked for are all returned; ties go to the smaller id. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.session import Scratch, bound_arrow_batches

TREES, BITS = 24, 64
#: The ascent stops when the ranges of all trees together hold this share of the shard's entries (an entry
#: counts once for each tree), and so many at least. Without clusters, near and far differ little, and less
#: than this misses more than a tenth of the nearest; clustered vectors do with far less.
SHARE, LEAST = 0.75, 2000
#: Vectors of a shard (about), bytes of vectors of a shard at most, bytes of queries of a block (about), and shards of a group.
SHARD_ROWS, SHARD_BYTES, BLOCK_BYTES, GROUP = 4096, 32 << 20, 8 << 20, 64
NEAREST = 5
SEED = 20_240_601


def directions(dim: int, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    """Random directions, a row for each bit of each tree."""
    return np.random.default_rng([seed, dim]).standard_normal((trees * BITS, dim)).astype(np.float32)


def hash_strings(vectors: np.ndarray, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    """Bit strings as integers, first bit highest: a row for each tree."""
    out = np.zeros((trees, len(vectors)), dtype=np.uint64)
    planes = directions(vectors.shape[1], trees, seed)
    power = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    for at in range(0, len(vectors), 4096):
        signs = (vectors[at : at + 4096].astype(np.float32) @ planes.T > 0).reshape(-1, trees, BITS)
        out[:, at : at + 4096] = (signs * power).sum(axis=2, dtype=np.uint64).T
    return out


def distinct_vectors(ids: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vectors, and the ``most`` smallest ids of each (filled up with -1)."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    rows = vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel()
    _, first, which = np.unique(rows, return_index=True, return_inverse=True)
    by = np.argsort(which, kind="stable")
    start = np.searchsorted(which[by], np.arange(len(first)))
    place = np.arange(len(by)) - start[which[by]]
    few = place < most
    out = np.full((len(first), most), -1, dtype=np.int64)
    out[which[by][few], place[few]] = ids[by][few]
    return vectors[first], out


class Shard:
    """One shard's vectors and its trees."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, keys: np.ndarray, order: np.ndarray) -> None:
        self.vectors, self.ids, self.keys, self.order = vectors, ids, keys, order
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, nearest: int = NEAREST) -> Shard:
        vectors, few = distinct_vectors(ids, vectors, nearest + 1)
        keys = hash_strings(vectors)
        order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        return cls(vectors, few, np.take_along_axis(keys, order.astype(np.int64), axis=1), order)

    def candidates(self, query_keys: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query the entries of the longest common prefix, over all trees, that gives enough."""
        trees, n = self.keys.shape
        queries = query_keys.shape[1]
        level = np.full(queries, 0)
        lows = np.zeros((trees, queries), dtype=np.int64)
        highs = np.full((trees, queries), n, dtype=np.int64)
        # The synchronous ascent, for all queries: the longest prefix whose ranges hold enough, by bisection.
        lo, hi = np.zeros(queries, dtype=np.int64), np.full(queries, BITS + 1)
        while (hi - lo > 1).any():
            level = (lo + hi) // 2
            a, b = self._ranges(query_keys, level)
            good = (b - a).sum(axis=0) >= enough
            lo, hi = np.where(good, level, lo), np.where(good, hi, level)
            lows, highs = np.where(good, a, lows), np.where(good, b, highs)
        for q in range(queries):
            yield np.unique(np.concatenate([self.order[t, lows[t, q] : highs[t, q]] for t in range(trees)]))

    def _ranges(self, query_keys: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        free = np.where(level >= BITS, np.uint64(0), ~np.uint64(0) >> np.minimum(level, BITS - 1).astype(np.uint64))
        a = np.stack([np.searchsorted(k, q & ~free, side="left") for k, q in zip(self.keys, query_keys, strict=True)])
        b = np.stack([np.searchsorted(k, q | free, side="right") for k, q in zip(self.keys, query_keys, strict=True)])
        return a, b

    def search(self, query_ids: np.ndarray, queries: np.ndarray, nearest: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``queries``, id and cosine of each query's best candidates here."""
        keys = hash_strings(queries)
        norms = np.sqrt((queries * queries).sum(axis=1))
        at, ids, cosines = [], [], []
        enough = max(LEAST, int(share * len(self.vectors)))
        for q, found in enumerate(self.candidates(keys, enough)):
            scores = (self.vectors[found] @ queries[q]) / (self.norms[found] * norms[q])
            most, best = nearest + 1, {}
            while True:
                # The entry of the query itself may be among the best, and ties at the edge count.
                some = scores >= np.partition(scores, len(scores) - most)[len(scores) - most] if len(found) > most else slice(None)
                every = ((-s, i) for s, e in zip(scores[some].tolist(), found[some], strict=True) for i in self.ids[e].tolist() if i >= 0 and i != query_ids[q])
                best = {}
                for s, i in sorted(every):
                    best.setdefault(i, s)
                if len(best) >= nearest or most >= len(found):
                    break
                most *= 2
            for i, s in list(best.items())[:nearest]:
                at.append(q)
                ids.append(i)
                cosines.append(-s)
        return np.array(at, np.int64), np.array(ids, np.int64), np.array(cosines, np.float64)


def keep_best(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``nearest`` best of each query, each id once; ties to the smaller id."""
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    # The first of equal (query, id) in this order is the nearest.
    _, first = np.unique(np.stack([at, ids], axis=1), axis=0, return_index=True)
    first.sort()
    at, ids, scores = at[first], ids[first], scores[first]
    start = np.searchsorted(at, at)
    few = np.arange(len(at)) - start < nearest
    return at[few], ids[few], scores[few]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component below 1: products neither overflow nor vanish, cosines stay as they are."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _by_dim(batch: pa.RecordBatch, column: int):
    """Length, rows and the matrix of the vectors (``scaled``) of each length in a column of lists."""
    lists = batch.column(column)
    size = lists.value_lengths().to_numpy()
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size)))
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        yield dim, own, scaled(flat[at[own][:, None] + np.arange(dim)[None, :]].astype(np.float64))


_SHARD = "shard int, dim int, vectors binary, ids binary, keys binary, entries binary"
_BLOCK = "block int, dim int, query_ids binary, queries binary"


def _packed(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays]


def _shards(batches):
    """Rows of each shard as its arrays, one for each length of vectors."""
    held: dict[tuple[int, int], list] = {}

    def flush(key):
        ids, vectors = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
        s = Shard.build(ids, vectors)
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), *_packed(s.vectors, s.ids, s.keys, s.order)], names=[c.split()[0] for c in _SHARD.split(", ")])

    for batch in batches:
        shard, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for dim, own, vectors in _by_dim(batch, 2):
            for one in np.unique(shard[own]).tolist():
                mine, key = shard[own] == one, (one, dim)
                held.setdefault(key, []).append((ids[own[mine]], vectors[mine]))
                if sum(len(x[0]) for x in held[key]) >= max(1, min(2 * SHARD_ROWS, SHARD_BYTES // (8 * dim))):
                    yield flush(key)
    for key in list(held):
        yield flush(key)


def _query_blocks(batches):
    """Queries of each block and length as arrays, in pieces of bounded size."""
    held: dict[tuple[int, int], list] = {}

    def flush(key):
        ids, vectors = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), *_packed(ids, vectors.astype(np.float64))], names=[c.split()[0] for c in _BLOCK.split(", ")])

    for batch in batches:
        block, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for dim, own, vectors in _by_dim(batch, 2):
            for one in np.unique(block[own]).tolist():
                mine, key = block[own] == one, (one, dim)
                held.setdefault(key, []).append((ids[own[mine]], vectors[mine]))
                if sum(x[1].nbytes for x in held[key]) >= 2 * BLOCK_BYTES:
                    yield flush(key)
    for key in list(held):
        yield flush(key)


def build_forest(vectors: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index: a row of arrays for each shard. ``vectors``: vec_id and embedding, all usable."""
    bound_arrow_batches(vectors.sparkSession)
    shards = max(1, -(-vectors.count() // shard_rows))
    # Dealt by a hash of id and vector, so that neither a repeated id nor a repeated vector gathers in a shard.
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "embedding")
    return scratch.table(dealt.repartitionById(shards, "shard").mapInArrow(_shards, _SHARD), "forest")


def search_forest(forest: DataFrame, queries: DataFrame, scratch: Scratch, nearest: int = NEAREST, share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest found. ``queries``: vec_id and embedding, all usable."""
    bound_arrow_batches(forest.sparkSession)
    shards = (forest.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, -(-(queries.agg(F.sum(F.size("embedding").cast("long") * 8)).first()[0] or 0) // block_bytes))
    asked = queries.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "embedding")
    packed = scratch.table(asked.repartitionById(blocks, "block").mapInArrow(_query_blocks, _BLOCK), "queries")
    if blocks == 1:
        # One block: its size is bounded. Each shard is a task.
        met = forest.repartitionById(shards, "shard").join(F.broadcast(packed), "dim").withColumn("group", F.lit(0))
    else:
        group = lambda column: F.floor(F.col(column) / GROUP).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        units = forest.withColumn("group", group("shard")).withColumn("block", every(blocks))
        met = units.join(packed.withColumn("group", every(-(-shards // GROUP))).hint("merge"), ["block", "dim", "group"])

    def answer(batches):
        held, best = None, None

        def told():
            at, ids, scores = best
            return pa.RecordBatch.from_arrays([pa.array(held[3][at]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for k in range(batch.num_rows):
                dim, asked, queries = batch.column(0)[k].as_py(), batch.column(5)[k].as_buffer(), batch.column(6)[k].as_buffer()
                vectors, ids, keys, order = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in ((1, np.float64), (2, np.int64), (3, np.uint64), (4, np.int32)))
                n = len(vectors) // dim
                shard = Shard(vectors.reshape(n, dim), ids.reshape(n, -1), keys.reshape(-1, n), order.reshape(-1, n))
                query_ids, wanted = np.frombuffer(asked, np.int64), np.frombuffer(queries, np.float64).reshape(-1, dim)
                new = shard.search(query_ids, wanted, nearest, share)
                # Shards that meet the same piece of a block come one after the other; their answers are merged.
                if held is not None and held[0] == dim and held[1].equals(asked) and held[2].equals(queries):
                    best = keep_best(*(np.concatenate(x) for x in zip(best, new, strict=True)), nearest)
                    continue
                if held is not None:
                    yield told()
                held, best = (dim, asked, queries, query_ids), keep_best(*new, nearest)
        if held is not None:
            yield told()

    found = met.select("dim", "vectors", "ids", "keys", "entries", "query_ids", "queries").mapInArrow(answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    unique = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return unique.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_neighbours(embeddings: DataFrame, is_query: Column, nearest: int = NEAREST, share: float = SHARE, shard_rows: int = SHARD_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Nearest neighbours of the rows that ``is_query`` marks (a condition on vec_id), among all rows."""
    scratch = Scratch(embeddings.sparkSession, "ann")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    forest = build_forest(rows, scratch, shard_rows)
    # A query id with several different vectors asks with each; a repeated row asks once.
    return search_forest(forest, rows.filter(is_query).distinct(), scratch, nearest, share, block_bytes)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
