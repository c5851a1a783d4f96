"""Nearest neighbours by inner product, from balanced posting lists.

Vectors lie in posting lists around centroids. A vector near the border of several
lists is put into all of them (its nearest lists, as far as their distance ratio
allows), so a query needs few lists to meet its neighbours. The vector itself stands
once, with its lists, in a block of related lists; a query goes once to each block that
has vectors in a list it reads, and is compared there with those in its lists. Centroids are the leaves
of a balanced bisection of a bounded sample; they are searched through a graph of
near centroids that every task holds in memory. A query takes the lists whose
centroids are at most a ratio farther than the nearest one, however many these are. The ratio is
fitted to the table: the true neighbours of some queries are found by comparing
them with every vector, and it is as far as these queries must go to meet them.

Distances to centroids are Euclidean in a space with one more dimension, where the
largest inner product is the least distance: that dimension brings all vectors to
the same length. Scores are inner products of the original vectors in double
precision. Equal vectors are indexed once and carry their smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import small_batches, stored

NEIGHBOURS = 20

# Vectors to a list before replication; centroids are fitted on a sample of SAMPLE
# distinct vectors and are at most MAX_CENTROIDS, so what is broadcast is bounded.
LIST_SIZE = 64
SAMPLE = 65536
MAX_CENTROIDS = 16384

# A vector goes to the lists at most so much farther than its nearest one, REPLICAS at most: one
# that lies between centroids is in several lists, one near its centroid in one.
REPLICA_RATIO = 1.06
REPLICAS = 8

# A query reads the lists at most so much farther than its nearest one, MIN_LISTS at least. The ratio
# is as large as FITTED queries need to meet this share of their true neighbours. USUAL_LISTS are
# asked of the graph at first, and twice as many as long as the ratio is not reached.
LIST_RATIO = 1.0
MIN_LISTS, USUAL_LISTS = 8, 64
RECALL = 0.95
FITTED = 256

# A query's nearest lists are compared first, as far as they lie in the block that has the most of
# them: the k-th score found there bounds what the other blocks put out.
FIRST_LISTS = 16

# Each vector stands once, in the block of its nearest list. A table is cut into BLOCKS blocks of
# related lists, of CHUNK vectors at least and BLOCK_BYTES at most; a longer list has several.
# TURN queries at most meet a block in one task, and fewer (LEAST_TURN at least) until there are TASKS.
CHUNK = 4096
BLOCKS = 16
BLOCK_BYTES = 32 << 20
TURN, LEAST_TURN, TASKS = 1 << 18, 1024, 36

# Within a block so many vectors are compared at once, with the queries that read one of their lists.
TILE = 1024

DEGREE = 24
RANDOM_LINKS = 4
# Leaves stand in the order of the bisection, where neighbours are related: links over
# these distances, both ways, reach tight groups that near centroids alone would not.
ORDER_LINKS = (1, 2, 5, 15, 50)
SEED = 5

# A search within a bound goes on from centroids so much farther. Rows searched together, centroids
# they go on from at once, and pairs of a row and a centroid compared at once.
BEYOND = 1.03
_GROUP, _FEW = 256, 32
_STEPS = 16384
_PAIRS = 2048


def _bisected(x: np.ndarray, leaves: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Means of `leaves` groups of equal size: halves along the direction of most spread, again and again."""
    if leaves == 1 or len(x) < 2:
        return [x.mean(axis=0)]
    centred = x - x.mean(axis=0)
    direction = rng.normal(size=x.shape[1]).astype(x.dtype)
    for _ in range(6):
        direction = centred.T @ (centred @ direction)
        direction /= np.linalg.norm(direction) or 1.0
    left = leaves // 2
    order = np.argsort(centred @ direction, kind="stable")
    cut = len(x) * left // leaves
    return _bisected(x[order[:cut]], left, rng) + _bisected(x[order[cut:]], leaves - left, rng)


def _turns(row: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """Numbers within each of `count` rows, in no order, and how many the longest has."""
    order = np.argsort(row, kind="stable")
    each = np.bincount(row, minlength=count)
    turn = np.empty(len(row), np.int64)
    turn[order] = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    return turn, int(each.max(initial=0))


@dataclass
class CentroidGraph:
    """Centroids and, for each, the centroids its search goes on to."""

    centroids: np.ndarray
    links: np.ndarray
    longest: float  # the greatest norm of an indexed vector
    filled: np.ndarray | None = None  # which lists hold vectors; None: not known yet

    @staticmethod
    def fitted(sample: np.ndarray, count: int, longest: float) -> CentroidGraph:
        """From augmented vectors; deterministic."""
        rng = np.random.default_rng(SEED)
        centroids = np.stack(_bisected(sample, min(count, len(sample)), rng)).astype(np.float32)
        n = len(centroids)
        near = min(DEGREE, n - 1)
        along = [(np.arange(n) + sign * far) % n for far in ORDER_LINKS for sign in (1, -1)]
        links = np.empty((n, near + RANDOM_LINKS + len(along)), np.int32)
        links[:, near : near + RANDOM_LINKS] = rng.integers(0, n, (n, RANDOM_LINKS))
        links[:, near + RANDOM_LINKS :] = np.stack(along, axis=1)
        squares = (centroids**2).sum(axis=1)
        for at in range(0, n, 1024):
            block = centroids[at : at + 1024]
            d = squares[None, :] - 2 * block @ centroids.T
            d[np.arange(len(block)), np.arange(at, at + len(block))] = np.inf
            if near:
                links[at : at + len(block), :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
        return CentroidGraph(centroids, links, longest)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        """Indexed vectors with the dimension that gives all the same length."""
        rest = np.sqrt(np.maximum(self.longest**2 - (x.astype(np.float64) ** 2).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)

    def aimed(self, q: np.ndarray) -> np.ndarray:
        """Queries in the same space; their length does not change the order of inner products."""
        norms = np.linalg.norm(q.astype(np.float64), axis=1, keepdims=True)
        scaled = q * (self.longest / np.where(norms > 0, norms, 1))
        return np.concatenate([scaled, np.zeros((len(q), 1))], axis=1).astype(np.float32)

    def _fresh(self, met: np.ndarray, row: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) of the nodes that their rows meet for the first time, each once; marked in `met` (rows x nodes, -1: not met)."""
        at = (row.astype(np.int32) * np.int32(len(self.centroids)) + nodes).ravel()
        at = at[met[at] < 0]
        # A node may stand in several of the lists just read: its last place is the one that stays.
        turn = np.arange(len(at), dtype=np.int32)
        met[at] = turn
        return np.divmod(at[met[at] == turn].astype(np.int64), len(self.centroids))

    def _distances(self, x: np.ndarray, lengths: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distances, but for the length of x."""
        d, size = np.empty(len(row), np.float32), min(_PAIRS, len(row))
        left, right = np.empty((size, x.shape[1]), np.float32), np.empty((size, x.shape[1]), np.float32)
        for at in range(0, len(row), _PAIRS):
            r, c = row[at : at + _PAIRS], node[at : at + _PAIRS]
            # Into the same memory again and again; all places are in range.
            a = np.take(x, r, axis=0, out=left[: len(r)], mode="clip")
            b = np.take(self.centroids, c, axis=0, out=right[: len(r)], mode="clip")
            d[at : at + _PAIRS] = lengths[c] - 2 * np.einsum("pd,pd->p", a, b)
        return d

    def _started(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, distances, met): where a search begins, alike for all rows."""
        n = len(self.centroids)
        start = np.unique(np.linspace(0, n - 1, min(n, 16 + int(2 * np.sqrt(n)))).astype(np.int64))
        met = np.full((len(x), n), -1, np.int32)
        met[:, start] = 0
        return start, lengths[start][None, :] - 2 * x @ self.centroids[start].T, met.ravel()

    def nearest(self, x: np.ndarray, wanted: int, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances), nearest first: a beam search along the links, for all rows of a group at once."""
        wanted = min(wanted, len(self.centroids))
        found = [self._beam(x[at : at + _GROUP], wanted, width) for at in range(0, len(x), _GROUP)]
        if not found:
            return np.zeros((0, wanted), np.int64), np.zeros((0, wanted), np.float32)
        return np.concatenate([nodes for nodes, _ in found]), np.concatenate([dist for _, dist in found])

    def _beam(self, x: np.ndarray, wanted: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.centroids)
        beam = min(n, wanted + wanted // 2 + 24)
        lengths = (self.centroids**2).sum(axis=1)
        start, dist, met = self._started(x, lengths)
        nodes, done = np.broadcast_to(start, dist.shape), np.zeros(dist.shape, bool)
        while True:
            if nodes.shape[1] > beam:
                best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                nodes, dist, done = (np.take_along_axis(v, best, axis=1) for v in (nodes, dist, done))
            elif not nodes.flags.writeable:
                nodes = nodes.copy()
            open_dist = np.where(done, np.inf, dist)
            k = min(width, nodes.shape[1])
            pick = np.argpartition(open_dist, k - 1, axis=1)[:, :k]
            row, place = np.nonzero(np.isfinite(np.take_along_axis(open_dist, pick, axis=1)))
            if not len(row):
                break
            place = pick[row, place]
            done[row, place] = True
            row, node = self._fresh(met, row[:, None], self.links[nodes[row, place]])
            far = self._distances(x, lengths, row, node)
            if nodes.shape[1] == beam:
                # What is farther than all of a full beam is not looked at again.
                nearer = far < dist.max(axis=1)[row]
                row, node, far = row[nearer], node[nearer], far[nearer]
            turn, more = _turns(row, len(x))
            # The rows' new nodes stand beside those they have; rows with fewer are filled up with none.
            new, at = np.zeros((len(x), more), np.int64), far
            far = np.full((len(x), more), np.inf, np.float32)
            new[row, turn], far[row, turn] = node, at
            nodes, dist = np.concatenate([nodes, new], axis=1), np.concatenate([dist, far], axis=1)
            done = np.concatenate([done, ~np.isfinite(far)], axis=1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :wanted]
        dist = np.take_along_axis(dist, order, axis=1) + (x**2).sum(axis=1)[:, None]
        return np.take_along_axis(nodes, order, axis=1), np.sqrt(np.maximum(dist, 0))

    def within(self, x: np.ndarray, bound: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) pairs: the centroids at most `bound` away from each row, by row.

        From the seeds of each row and the common starts the search goes on along the links
        of every centroid within the bound or a little beyond, each once.
        """
        rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        lengths = (self.centroids**2).sum(axis=1)
        for at in range(0, len(x), _FEW):
            part = x[at : at + _FEW]
            squares = (part**2).sum(axis=1)
            reach = (bound[at : at + len(part)] ** 2 - squares).astype(np.float32)
            beyond = ((bound[at : at + len(part)] * BEYOND) ** 2 - squares).astype(np.float32)
            start, dist, met = self._started(part, lengths)
            row, node = self._fresh(met, np.arange(len(part))[:, None], seeds[at : at + len(part)].astype(np.int32))
            d = np.concatenate([dist.ravel(), self._distances(part, lengths, row, node)])
            row = np.concatenate([np.repeat(np.arange(len(part)), len(start)), row])
            node = np.concatenate([np.tile(start, len(part)), node])
            while len(row):
                inside = d <= reach[row]
                rows.append(row[inside] + at)
                lists.append(node[inside])
                on = d <= beyond[row]
                row, node = row[on], node[on]
                steps = [self._fresh(met, row[i : i + _STEPS, None], self.links[node[i : i + _STEPS]]) for i in range(0, len(row), _STEPS)]
                row, node = (np.concatenate([s[k] for s in steps]) if steps else np.zeros(0, np.int64) for k in (0, 1))
                d = self._distances(part, lengths, row, node)
        row, node = np.concatenate(rows), np.concatenate(lists)
        order = np.argsort(row, kind="stable")
        return row[order], node[order]

    def among(self, filled: Iterable[int]) -> CentroidGraph:
        """The graph with what is known of its lists."""
        holds = np.zeros(len(self.centroids), bool)
        holds[list(filled)] = True
        return replace(self, filled=holds)

    def lists(self, x: np.ndarray, ratio: float, least: int, usual: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs by row: the lists of each row within the ratio of its nearest, `least` at least and `most` at most.

        The graph is asked for the `usual` nearest lists, then for all within the ratio for
        the rows whose farthest list is still within it. The former stand nearest first.
        """
        end = len(self.centroids) if most is None else min(most, len(self.centroids))
        wanted = min(usual, end)
        while True:
            nodes, dist = self.nearest(x, wanted)
            farthest = dist[:, -1].copy()
            if self.filled is not None:
                # An empty list is no list: those that hold vectors come first, in order.
                dist = np.where(self.filled[nodes], dist, np.inf)
                order = np.argsort(dist, axis=1, kind="stable")
                nodes, dist = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(dist, order, axis=1)
            if wanted == end or np.isfinite(dist[:, min(least, end) - 1]).all():
                break
            wanted = min(wanted * 2, end)
        bound = dist[:, :1] * ratio + 1e-6
        chosen = np.isfinite(dist) & (dist <= bound)
        chosen[:, :least] = np.isfinite(dist[:, :least])
        row, place = np.nonzero(chosen)
        lists = nodes[row, place]
        todo = np.flatnonzero((farthest <= bound[:, 0]) & (wanted < end))
        if len(todo):
            far_row, far = self.within(x[todo], bound[todo, 0].astype(np.float64), nodes[todo])
            if self.filled is not None:
                far_row, far = far_row[self.filled[far]], far[self.filled[far]]
            # What the beam has found already keeps its place.
            marked = np.zeros((len(x), len(self.centroids)), bool)
            marked[row, lists] = True
            far_row = todo[far_row]
            new = ~marked[far_row, far]
            row, lists = np.concatenate([row, far_row[new]]), np.concatenate([lists, far[new]])
            order = np.argsort(row, kind="stable")
            row, lists = row[order], lists[order]
        return row, lists


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame, keep: int, id_col: str, vector_col: str) -> DataFrame:
    """(size, vector: array<float>, first, hash, members): each usable vector once with its `keep` smallest ids."""
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    named = named.where(F.col("id").isNotNull() & usable(F.col("vector")))
    # Sorted by hash first, and compared as vectors only where these are equal. The rank's limit
    # holds within each task before rows meet, so a vector of many rows sends few.
    alike = Window.partitionBy("hash", "vector").orderBy("id")
    few = named.distinct().withColumn("hash", F.xxhash64("vector"))
    few = few.withColumn("_place", F.row_number().over(alike)).where(F.col("_place") <= keep)
    whole = alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = few.withColumn("members", F.collect_list("id").over(whole)).where(F.col("_place") == 1)
    return met.select(F.size("vector").alias("size"), "vector", F.col("members")[0].alias("first"), "hash", "members")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_numpy(zero_copy_only=False)
    return np.stack(rows).astype(np.float32)


_ROWS = 1024

KEY = "first long, hash long"


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = (np.arange(len(flat) + 1, dtype=np.int64) * flat.shape[1]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat.reshape(-1))])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """The matrix whose rows `_binary` has made."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _posted(graph: CentroidGraph):
    """Vectors with the lists they are put into, nearest first."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                x = _matrix(batch.column(0))
                row, lists = graph.lists(graph.augmented(x), REPLICA_RATIO, 1, REPLICAS, REPLICAS)
                offsets = pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32))
                taken = pa.ListArray.from_arrays(offsets, pa.array(lists.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), _binary(x), taken], ["first", "hash", "data", "lists"])

    return post


def _asked(graph: CentroidGraph, ratio: float, usual: int, blocks: np.ndarray):
    """Queries with the lists they read, as bits, and the block that has the most of their nearest ones."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                x = _matrix(batch.column(0))
                row, lists = graph.lists(graph.aimed(x), ratio, MIN_LISTS, usual)
                reads = np.zeros((len(x), len(graph.centroids)), bool)
                reads[row, lists] = True
                # A row's lists stand together, its nearest first.
                near = np.arange(len(row)) - np.searchsorted(row, row) < FIRST_LISTS
                votes = np.zeros((len(x), blocks.max() + 1), np.int32)
                np.add.at(votes, (row[near], blocks[lists[near]]), 1)
                own = pa.array(votes.argmax(axis=1).astype(np.int32))
                columns = [batch.column(1), batch.column(2), _binary(x), _binary(np.packbits(reads, axis=1)), own]
                yield pa.RecordBatch.from_arrays(columns, ["first", "hash", "data", "reads", "own"])

    return ask


def _sent(held: np.ndarray, near: bool):
    """A query once for each block that has vectors in a list it reads: its own block (`near`), or all others.

    `held` says of each block the lists its vectors are in. What a query reads goes along as
    bits, one for each list of the block.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.T.astype(np.float32)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                names = batch.schema.names
                reads = np.unpackbits(_unpacked(batch.column(names.index("reads")), np.uint8), axis=1, count=held.shape[1])
                met = reads.astype(np.float32) @ wanted > 0
                own = np.zeros(met.shape, bool)
                own[np.arange(len(met)), batch.column(names.index("own")).to_numpy()] = True
                met &= own == near
                for block in np.flatnonzero(met.any(axis=0)):
                    rows = np.flatnonzero(met[:, block])
                    taken = batch.select(["first", "hash", "data", "floor"]).take(pa.array(rows))
                    bits = _binary(np.packbits(reads[rows][:, held[block]], axis=1))
                    where = pa.array(np.full(len(rows), block, np.int32))
                    yield pa.RecordBatch.from_arrays([*taken.columns, bits, where], ["first", "hash", "data", "floor", "reads", "block"])

    return send


def _true_neighbours(queries: np.ndarray, keep: int):
    """(query, score, data): of each task's vectors the `keep` with the largest inner products with each query but equal ones."""
    wanted = queries.astype(np.float64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, data = np.empty((len(wanted), 0)), np.empty((0, queries.shape[1]), np.float32)
        held = np.empty((len(wanted), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            fresh = wanted @ x.astype(np.float64).T
            row_of = {v.tobytes(): i for i, v in enumerate(x)}
            for i, q in enumerate(queries):
                if (same := row_of.get(q.tobytes())) is not None:
                    fresh[i, same] = -np.inf
            scores = np.concatenate([scores, fresh], axis=1)
            held = np.concatenate([held, np.broadcast_to(np.arange(len(data), len(data) + len(x)), fresh.shape)], axis=1)
            data = np.concatenate([data, x])
            if scores.shape[1] > keep:
                best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                scores, held = np.take_along_axis(scores, best, axis=1), np.take_along_axis(held, best, axis=1)
            rows, at = np.unique(held, return_inverse=True)
            data, held = data[rows], at.reshape(held.shape)
        query, place = np.nonzero(np.isfinite(scores))
        columns = [pa.array(query.astype(np.int32)), pa.array(scores[query, place]), pa.array([data[r].tobytes() for r in held[query, place]], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["query", "score", "data"])

    return search


def fitted_ratio(graph: CentroidGraph, distinct: DataFrame, query_vectors: DataFrame, k: int, least: float, recall: float) -> float:
    """The ratio at which sampled queries meet the share `recall` of their k true neighbours; `least` at least.

    Collected are FITTED queries and their neighbours, whatever the size of the table.
    """
    sample = query_vectors.orderBy(F.xxhash64("hash"), "first").limit(FITTED).select("vector").toArrow().column("vector")
    if not len(sample):
        return least
    queries = _matrix(sample)
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "data")
    found = distinct.select("vector").mapInArrow(_true_neighbours(queries, k), "query int, score double, data binary")
    truth = found.withColumn("_place", F.row_number().over(by_query)).where(F.col("_place") <= k).select("query", "data").toArrow()
    if not truth.num_rows:
        return least
    owner = truth.column("query").to_numpy()
    vectors = np.frombuffer(b"".join(truth.column("data").to_pylist()), np.float32).reshape(len(owner), -1)
    aimed = graph.aimed(queries).astype(np.float64)
    # Each sampled query's distance to every list, relative to its nearest one that holds vectors.
    far = np.stack([np.linalg.norm(graph.centroids - q, axis=1) for q in aimed])
    nearest = np.where(graph.filled, far, np.inf).min(axis=1) if graph.filled is not None else far.min(axis=1)
    needed = np.full(len(owner), np.inf)
    for at in range(0, len(vectors), 256):
        row, lists = graph.lists(graph.augmented(vectors[at : at + 256]), REPLICA_RATIO, 1, REPLICAS, REPLICAS)
        np.minimum.at(needed, row + at, far[owner[row + at], lists] / np.maximum(nearest[owner[row + at]], 1e-12))
    if recall <= 0:
        return least
    return max(least, float(np.quantile(needed, min(recall, 1.0), method="higher")) * (1 + 1e-6))


class _Block:
    """The vectors of a block, by list, and what queries find among them."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        first, mark = rows.column("first").to_numpy(), rows.column("hash").to_numpy()
        lists = rows.column("lists").chunk(0)
        starts, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        starts = starts - starts[0]
        known, local = np.unique(flat, return_inverse=True)
        count = np.diff(starts)
        member = np.full((len(first), count.max()), len(known), np.int32)
        owner = np.repeat(np.arange(len(first)), count)
        member[owner, np.arange(len(flat)) - starts[owner]] = local
        order = np.lexsort((first, member[:, 0]))
        self.lists, self.member, self.first, self.mark = len(known), member[order], first[order], mark[order]
        self.vectors = _unpacked(rows.column("data").chunk(0), np.float32)[order]
        norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))
        self.longest = norms.max()
        self.scaled = (self.vectors / self.longest).astype(np.float32)
        # Which lists the vectors of each tile are in.
        tile = np.arange(len(first)) // TILE
        held = np.zeros((len(known) + 1, tile[-1] + 1), np.float32)
        held[self.member, tile[:, None]] = 1
        self.held = held[:-1]

    def best(self, queries: pa.RecordBatch, keep: int) -> pa.RecordBatch:
        """The `keep` best vectors in the lists that each query reads, as far as they reach its floor."""
        at = {name: queries.column(i) for i, name in enumerate(queries.schema.names)}
        q = _unpacked(at["data"], np.float32).astype(np.float64)
        floor = at["floor"].to_numpy(zero_copy_only=False).astype(np.float64)
        bits = np.unpackbits(_unpacked(at["reads"], np.uint8), axis=1, count=self.lists)
        norms = np.sqrt((q**2).sum(axis=1))
        scaled = (q / norms[:, None]).astype(np.float32)
        # In single precision, of vectors no longer than 1: off by less than this.
        off = (q.shape[1] + 8) * 2.0**-23
        bound = floor / (norms * self.longest)
        unknown = np.isneginf(bound)
        top = np.full((len(q), keep) if unknown.any() else (0, 0), -np.inf, np.float32)
        met = bits.astype(np.float32) @ self.held > 0
        reads = np.concatenate([bits, np.zeros((len(bits), 1), np.uint8)], axis=1).astype(bool)
        found = []
        for tile in np.flatnonzero(met.any(axis=0)):
            here = slice(tile * TILE, min((tile + 1) * TILE, len(self.first)))
            rows = np.flatnonzero(met[:, tile])
            rough = (scaled if len(rows) == len(q) else scaled[rows]) @ self.scaled[here].T
            hit = rough >= (bound[rows] - off).astype(np.float32)[:, None]
            if unknown.any() and (loose := np.flatnonzero(np.isneginf(bound[rows]))).size:
                hit[loose] = self._likely(rough[loose], reads[rows[loose]], here, keep)
            place = np.flatnonzero(hit)
            row, col = np.divmod(place, rough.shape[1])
            score, row, col = rough.ravel()[place], rows[row], col + here.start
            read = reads[row[:, None], self.member[col]].any(axis=1)
            row, col, score = row[read], col[read], score[read]
            found.append((row, col, score))
            if (vague := unknown[row]).any():
                # The best scores so far are the bound of a query without a floor.
                turn, more = _turns(row[vague], len(q))
                fresh = np.full((len(q), more), -np.inf, np.float32)
                fresh[row[vague], turn] = score[vague]
                top = np.concatenate([top, fresh], axis=1)
                top = np.partition(top, more, axis=1)[:, more:] if more else top
                bound[unknown] = top.min(axis=1)[unknown]
        row, col, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        # The bound may have risen since.
        near = score >= bound[row] - off
        row, col = row[near], col[near]
        # The exact score is summed pair by pair, alike wherever the pair is met.
        score = np.empty(len(row))
        for i in range(0, len(row), _STEPS):
            some = slice(i, i + _STEPS)
            score[some] = (q[row[some]] * self.vectors[col[some]].astype(np.float64)).sum(axis=1)
        reached = score >= floor[row]
        row, col, score = row[reached], col[reached], score[reached]
        order = np.lexsort((self.first[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        near = np.arange(len(row)) - np.searchsorted(row, row) < keep
        row, col, score = row[near], col[near], score[near]
        taken = pa.array(row)
        columns = [at["first"].take(taken), at["hash"].take(taken), pa.array(self.first[col]), pa.array(self.mark[col]), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, ["q_first", "q_hash", "first", "hash", "score"])

    def _likely(self, rough: np.ndarray, reads: np.ndarray, here: slice, keep: int) -> np.ndarray:
        """Which vectors of a tile can be among the `keep` best of queries without a bound."""
        count, most = rough.shape[1], 4 * keep
        if count > most:
            best = np.argpartition(rough, count - most, axis=1)[:, -most:]
            hit = np.zeros(rough.shape, bool)
            np.put_along_axis(hit, best, True, axis=1)
            few = np.flatnonzero(reads[np.arange(len(reads))[:, None, None], self.member[here][best]].any(axis=2).sum(axis=1) < keep)
        else:
            hit, few = np.ones(rough.shape, bool), np.zeros(0, np.int64)
        # With too few in the lists they read, all that are in these lists.
        for at in range(0, len(few), 64):
            some = few[at : at + 64]
            hit[some] = reads[some][:, self.member[here]].any(axis=2)
        return hit


def _compared(keep: int):
    """Blocks and queries of a task, by part, the vectors of a part first."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept, block = None, [], None
        for batch in batches:
            parts, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(parts)]):
                if start == stop:
                    continue
                if parts[start] != part:
                    part, kept, block = parts[start], [], None
                run = batch.slice(start, stop - start)
                if not asks[start]:
                    kept.append(run.select(["first", "hash", "data", "lists"]))
                    continue
                if kept:
                    block, kept = _Block(pa.Table.from_batches(kept)), []
                if block:
                    for at in range(0, run.num_rows, _ROWS):
                        yield block.best(run.slice(at, _ROWS).select(["first", "hash", "data", "floor", "reads"]), keep)

    return compare


def blocks_of(homes: Iterable[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, parts) of each list: lists in turn share a block while it has at most `size` vectors, a longer list has several blocks.

    `homes` counts the vectors whose nearest list it is.
    """
    block, parts, at, held = [], [], 0, 0
    for count in homes:
        if held and held + count > size:
            at, held = at + 1, 0
        block.append(at)
        parts.append(max(1, -(-int(count) // size)))
        if parts[-1] > 1:
            at += parts[-1]
        else:
            held += int(count)
    return np.array(block, np.int32), np.array(parts, np.int32)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = NEIGHBOURS,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    list_size: int = LIST_SIZE,
    list_ratio: float = LIST_RATIO,
    usual_lists: int = USUAL_LISTS,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which `is_query` holds, among all rows but its own id.

    Null and zero vectors, vectors with null or non-finite components and rows without
    id take no part, neither as queries nor as candidates. Ties go to the smaller id.
    A repeated row counts once. Fewer than k candidates are all returned; a table
    without usable vectors gives no rows. A query reads all lists within a ratio of its nearest
    one: `list_ratio`, or as far as sampled queries must go to meet the share `recall` of their
    neighbours; `usual_lists` is the number the graph is asked for first. Vectors of different
    sizes have no inner product: each size has an index of its own, built one after another.
    """
    spark = vectors.sparkSession
    small_batches(spark, rows=4096)
    # One more than k, for the query's own id.
    distinct = stored(distinct_vectors(vectors, k + 1, id_col, vector_col), "vectors")
    asked = vectors.where(F.coalesce(is_query, F.lit(False))).select(
        F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<float>").alias("vector")
    )
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("vector"))).distinct()
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for row in distinct.select("size").distinct().orderBy("size").collect():
        alike = distinct.where(F.col("size") == row["size"]).drop("size")
        asking = asked.where(F.size("vector") == row["size"])
        found = found.unionByName(_of_one_size(alike, asking, k, list_size, list_ratio, usual_lists, recall))
    return found


def _of_one_size(
    distinct: DataFrame, asked: DataFrame, k: int, list_size: int, list_ratio: float, usual_lists: int, recall: float
) -> DataFrame:
    """The answers to `asked` (query_id, vector) among the `distinct` vectors; all have the same size, and there are some."""
    spark = distinct.sparkSession
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    total, longest = distinct.agg(F.count(F.lit(1)), F.max(norm)).first()
    sample = distinct.orderBy(F.xxhash64("hash"), "first").limit(SAMPLE).select("vector").toArrow().column("vector")
    bare = CentroidGraph(np.empty((0, 0)), np.empty((0, 0)), float(longest))
    count = int(min(MAX_CENTROIDS, max(1, total // list_size)))
    graph = CentroidGraph.fitted(bare.augmented(_matrix(sample)), count, float(longest))

    postings = distinct.select("vector", "first", "hash").mapInArrow(_posted(graph), f"{KEY}, data binary, lists array<int>")
    postings = stored(postings, "postings")
    # One row per centroid: bounded by MAX_CENTROIDS.
    each = postings.select(F.posexplode("lists").alias("at", "list")).groupBy("list").agg(F.count_if(F.col("at") == 0).alias("homes")).collect()
    known = graph.among(r["list"] for r in each)
    homes = np.zeros(len(graph.centroids), np.int64)
    homes[[r["list"] for r in each]] = [r["homes"] for r in each]
    width = 4 * (graph.centroids.shape[1] - 1)
    block, parts = blocks_of(homes, min(max(CHUNK, total // BLOCKS), max(1, BLOCK_BYTES // width)))
    cells = F.broadcast(spark.createDataFrame(pa.table({"home": np.arange(len(homes), dtype=np.int32), "start": block, "parts": parts})))
    dealt = F.col("start") + F.pmod(F.xxhash64("first", "hash"), "parts").cast("int")
    placed = postings.withColumn("home", F.col("lists")[0]).join(cells, "home").select("first", "hash", "data", "lists", dealt.alias("block"))
    # Which lists the vectors of each block are in: a bit for each block and centroid at most.
    pairs = placed.select("block", F.explode("lists").alias("list")).distinct().toArrow()
    held = np.zeros((int((block + parts).max()), len(homes)), bool)
    held[pairs.column("block").to_numpy(), pairs.column("list").to_numpy()] = True

    # The hash comes first, so that few vectors are compared in the join's sort.
    wanted = asked.select("vector").distinct().withColumn("hash", F.xxhash64("vector"))
    query_vectors = stored(distinct.join(wanted, ["hash", "vector"], "left_semi").select("vector", "first", "hash"), "wanted")
    ratio = fitted_ratio(known, distinct, query_vectors, k, list_ratio, recall)
    # Searches and what comes of them are far more than the few bytes of a query: dealt to more tasks than these ask for.
    count = query_vectors.count()
    deals = max(TASKS, -(-count // CHUNK))
    queries = query_vectors.repartition(deals, "hash").mapInArrow(_asked(known, ratio, usual_lists, block), f"{KEY}, data binary, reads binary, own int")
    queries = stored(queries, "asked")
    turns = max(1, -(-count // TURN))
    by_query = Window.partitionBy("q_first", "q_hash").orderBy(F.desc("score"), "first", "hash")

    def best_of(bounded: DataFrame, near: bool, turns: int) -> DataFrame:
        """The k + 1 best vectors of each block that reach a query's `floor`, in the lists that it reads."""
        spread = bounded.repartition(deals, "first", "hash").mapInArrow(_sent(held, near), f"{KEY}, data binary, floor double, reads binary, block int")
        spread = spread.withColumn("turn", F.pmod(F.xxhash64("first", "hash"), F.lit(turns)).cast("int"))
        vectors = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        both = vectors.withColumn("asks", F.lit(False)).unionByName(spread.withColumn("asks", F.lit(True)), allowMissingColumns=True)
        part = (F.col("block") * turns + F.col("turn")).alias("part")
        both = both.select(part, "asks", "first", "hash", "data", "lists", "floor", "reads")
        # Each part has its own task; the vectors come before the queries.
        met = both.repartitionById(len(held) * turns, "part").sortWithinPartitions("part", "asks")
        return met.mapInArrow(_compared(k + 1), "q_first long, q_hash long, first long, hash long, score double")

    nothing = F.lit(float("-inf"))
    near = stored(best_of(queries.withColumn("floor", nothing), True, turns), "near")
    lowest = near.groupBy("q_first", "q_hash").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("floor"))
    floors = lowest.where(F.col("found") == k + 1).select(F.col("q_first").alias("first"), F.col("q_hash").alias("hash"), "floor")
    bounded = queries.join(floors, ["first", "hash"], "left").withColumn("floor", F.coalesce("floor", nothing))
    far = best_of(bounded, False, max(turns, min(-(-count // LEAST_TURN), -(-TASKS // len(held)))))
    best = near.unionByName(far).withColumn("_place", F.row_number().over(by_query)).where(F.col("_place") <= k + 1)
    # The ids behind each vector found, in the order of the result.
    members = distinct.select("first", "hash", "members")
    rows = best.join(members, ["first", "hash"]).select("q_first", "q_hash", "score", F.explode("members").alias("vec_id"))
    by_id = Window.partitionBy("q_first", "q_hash").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("_place", F.row_number().over(by_id)).where(F.col("_place") <= k + 1)
    answers = rows.groupBy("q_first", "q_hash").agg(F.sort_array(F.collect_list(F.struct("_place", "vec_id", "score"))).alias("found"))
    answers = answers.join(
        distinct.select(F.col("first").alias("q_first"), F.col("hash").alias("q_hash"), "vector"), ["q_first", "q_hash"]
    ).select("vector", "found")
    own = asked.join(answers, "vector")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    ranked = own.select("query_id", F.posexplode(others).alias("_at", "_found"))
    return ranked.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_found.vec_id").alias("vec_id"), F.col("_found.score").alias("score"))
