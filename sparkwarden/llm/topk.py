"""Exact top-k search by integer inner product: columnar branch and bound.

Vectors are scaled to integers and dealt out by a hash of their id into lanes of a
bounded number of rows. A lane is stored as one block in vertical layout: dimension
after dimension, each with the values of all rows. A block of queries meets every
lane. Products are summed block of dimensions by block of dimensions, those of most
mass first; after each block a candidate can gain at most the product of both
vectors' remaining masses (Cauchy and Schwarz). Candidates that cannot reach the
query's k-th best score so far go, and the others are moved together.

A pair of blocks is one group of bounded size, so a task's memory does not grow with
the table. Scores are exact: partial sums stay below what the number type holds
without rounding, and vectors too large for that are multiplied as Python integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import small_batches, stored

NEIGHBOURS = 20
SCALE = 64

# Rows of one lane and queries of one group: together they fix the memory of a task.
LANE_ROWS = 8192
GROUP_QUERIES = 2048

# Rows and queries whose sums are held at once, and dimensions added between two looks at the bounds.
SLAB_ROWS = 2048
SLAB_QUERIES = 256
DIMENSIONS = 16

# Rows are moved together when fewer than this share of them is alive for any query of the slab;
# pairs are followed one by one when fewer than this share of all pairs is alive.
ROWS_ALIVE = 0.75
PAIRS_ALIVE = 0.06

LONG = (-(1 << 63), (1 << 63) - 1)

# Up to these products of masses, sums and bounds are exact (to less than half) in the type.
EXACT = ((np.float32, 2.0**20), (np.float64, 2.0**48))


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as array<long>; components beyond long take its ends."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component. Zero and empty vectors are usable."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(finite, F.lit(False))


def _packed(keys: list[str]):
    """A group's vectors as one block in vertical layout: values of a dimension side by side."""

    def pack(group: pa.Table) -> pa.Table:
        values = group.column("values").combine_chunks()
        matrix = np.asarray(values.flatten()).reshape(len(group), -1)
        width = next(w for w in (1, 2, 4, 8) if w == 8 or not matrix.size or np.abs(matrix).max() < 2 ** (8 * w - 1))
        columns = {k: group.column(k).combine_chunks()[:1] for k in keys}
        for name in ("id", "mark"):
            columns[name] = pa.array([np.asarray(group.column(name)).astype("<i8").tobytes()], pa.binary())
        columns["width"] = pa.array([width], pa.int32())
        columns["data"] = pa.array([np.ascontiguousarray(matrix.T).astype(f"<i{width}").tobytes()], pa.binary())
        return pa.table(columns)

    return pack


def _unpacked(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, marks and values (dimensions x rows) of the blocks of one cell, side by side."""
    ids, marks, values = [], [], []
    for row in block.to_pylist():
        ids.append(np.frombuffer(row["id"], "<i8"))
        marks.append(np.frombuffer(row["mark"], "<i8"))
        values.append(np.frombuffer(row["data"], f"<i{row['width']}").reshape(row["dims"], len(ids[-1])))
    return np.concatenate(ids), np.concatenate(marks), np.concatenate(values, axis=1)


def _squares(values: np.ndarray, wide: bool) -> np.ndarray:
    return values.astype(object if wide else np.float64) ** 2


def _roots(squares: np.ndarray) -> np.ndarray:
    """Square roots, rounded up if anything."""
    if squares.dtype == object:
        return np.array([math.isqrt(int(s)) + 1 for s in squares.ravel()], object).reshape(squares.shape)
    return np.sqrt(squares) * (1 + 1e-9)


class Cell:
    """Some queries and some candidates, with the bounds of what each block of dimensions can still add."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray):
        """Both as dimensions x vectors of integers."""
        largest = max(float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (queries, rows))
        wide = largest * largest * max(1, len(rows)) >= EXACT[-1][1]
        q_mass, r_mass = _squares(queries, wide), _squares(rows, wide)
        order = np.argsort(-(q_mass.sum(axis=1) * r_mass.sum(axis=1)).astype(np.float64), kind="stable")
        product = float(q_mass.sum(axis=0).max(initial=0)) ** 0.5 * float(r_mass.sum(axis=0).max(initial=0)) ** 0.5
        self.kind = object if wide else next((t for t, most in EXACT if product < most), object)
        self.low = -math.inf
        self.queries, self.rows = queries[order].astype(self.kind), rows[order].astype(self.kind)
        self.starts = list(range(0, len(rows), DIMENSIONS))
        self.q_rest = [self._rest(q_mass[order], s) for s in self.starts]
        self.r_rest = [self._rest(r_mass[order], s) for s in self.starts]

    def _rest(self, mass: np.ndarray, start: int) -> np.ndarray:
        """Mass of each vector in the dimensions after the block that begins at `start`."""
        return _roots(mass[start + DIMENSIONS :].sum(axis=0)).astype(self.kind)

    def slab(self, qs: slice, rs: slice, floor: np.ndarray, own: list[tuple[int, int]], k: int):
        """(query, row, score) of the pairs that reach the floor, and the floors raised by what this slab holds.

        `own` are pairs that do not count. Positions are within the slab.
        """
        q, r = self.queries[:, qs], self.rows[:, rs]
        columns = np.arange(r.shape[1])
        sums = np.zeros((q.shape[1], r.shape[1]), self.kind)
        for i, j in own:
            sums[i, j] = self.low
        pairs = None
        for b, start in enumerate(self.starts):
            part = slice(start, start + DIMENSIONS)
            q_rest, r_rest = self.q_rest[b][qs], self.r_rest[b][rs]
            if pairs is None:
                sums += q[part].T @ r[part][:, columns]
                alive = sums + q_rest[:, None] * r_rest[columns][None, :] >= (floor - 0.5)[:, None]
                count = int(np.count_nonzero(alive))
                if count < PAIRS_ALIVE * q.shape[1] * r.shape[1]:
                    at, col = np.nonzero(alive)
                    pairs = at, columns[col], sums[at, col]
                elif count < alive.size:
                    used = alive.any(axis=0)
                    if used.mean() < ROWS_ALIVE:
                        columns, sums = columns[used], np.ascontiguousarray(sums[:, used])
            else:
                at, col, score = pairs
                score = score + (q[part][:, at] * r[part][:, col]).sum(axis=0)
                alive = score + q_rest[at] * r_rest[col] >= floor[at] - 0.5
                pairs = at[alive], col[alive], score[alive]
        if pairs is None:
            if sums.shape[1] >= k:
                kth = np.partition(sums, sums.shape[1] - k, axis=1)[:, sums.shape[1] - k]
                floor = self.raised(floor, np.arange(len(floor)), self.within_long(kth))
            at, col = np.nonzero(sums >= floor[:, None])
            pairs = at, columns[col], sums[at, col]
        at, col, score = pairs
        real = score > self.low
        return at[real], col[real], self.within_long(score[real]), floor

    def within_long(self, score: np.ndarray) -> np.ndarray:
        """Scores beyond long take its ends; only Python integers go that far."""
        if self.kind is not object:
            return score
        return np.array([min(max(int(s), LONG[0]), LONG[1]) for s in score], object)

    def raised(self, floor: np.ndarray, at: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Floors after these queries have k candidates of at least this score; the lowest long bounds nothing."""
        reached = np.where(score <= LONG[0], self.low, score)
        floor[at] = np.maximum(floor[at], reached)
        return floor


def best_of_cell(q_ids, queries, ids, rows, k: int):
    """(position of the query, id, score) of each query's k best candidates, ties to smaller ids.

    Candidates with the query's own id do not count.
    """
    cell = Cell(queries, rows)
    found = []
    for q0 in range(0, len(q_ids), SLAB_QUERIES):
        qs = slice(q0, min(q0 + SLAB_QUERIES, len(q_ids)))
        n = qs.stop - q0
        floor = np.full(n, cell.low, cell.kind)
        at, best, score = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, cell.kind)
        places: dict[int, list[int]] = {}
        for i, v in enumerate(q_ids[qs].tolist()):
            places.setdefault(v, []).append(i)
        for r0 in range(0, len(ids), SLAB_ROWS):
            rs = slice(r0, min(r0 + SLAB_ROWS, len(ids)))
            same = np.flatnonzero(np.isin(ids[rs], q_ids[qs]))
            own = [(i, int(j)) for j in same for i in places[int(ids[r0 + j])]]
            a, c, s, floor = cell.slab(qs, rs, floor, own, k)
            at, best, score = np.concatenate([at, a]), np.concatenate([best, ids[r0 + c]]), np.concatenate([score, s])
            order = np.lexsort((best, -score, at)) if cell.kind is not object else np.array(
                sorted(range(len(at)), key=lambda x: (at[x], -score[x], best[x])), int
            )
            at, best, score = at[order], best[order], score[order]
            first = np.searchsorted(at, np.arange(n))
            place = np.arange(len(at)) - first[at]
            keep = place < k
            full = np.flatnonzero(place == k - 1)
            floor = cell.raised(floor, at[full], score[full])
            at, best, score = at[keep], best[keep], score[keep]
        found.append((at + q0, best, score))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


RESULT = "query_id long, mark long, vec_id long, score long"


def _searched(k: int):
    def search(queries: pa.Table, lanes: pa.Table) -> pa.Table:
        found = {"query_id": [], "mark": [], "vec_id": [], "score": []}
        if len(queries) and len(lanes):
            q_ids, q_marks, q = _unpacked(queries)
            ids, _, rows = _unpacked(lanes)
            at, best, score = best_of_cell(q_ids, q, ids, rows, k)
            found = {"query_id": q_ids[at], "mark": q_marks[at], "vec_id": best, "score": score.astype(np.int64)}
        return pa.table({n: pa.array(v, pa.int64()) for n, v in found.items()})

    return search


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = NEIGHBOURS,
    *,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    lane_rows: int = LANE_ROWS,
    group_queries: int = GROUP_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row for which `is_query` holds the k highest scores among all rows but its own id.

    The score is the inner product of the vectors scaled to integers; ties go to the
    smaller id. Null vectors, vectors with null or non-finite components and rows
    without id take no part; zero vectors do. Vectors of different lengths have no
    score with each other. A repeated row counts once; rows that share an id and have
    different vectors are rows of their own, each with its list as a query, never with
    each other as candidates. Fewer than k candidates are all returned; an empty table
    gives no rows. Scores beyond long take its ends, before ranking. Other columns do not matter.
    """
    spark = vectors.sparkSession
    small_batches(spark, rows=4096)
    vector = F.col(f"`{vector_col}`")
    taken = vectors.where(usable(vector) & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        scaled(vector, scale).alias("values"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    )
    rows = taken.groupBy("id", "values").agg(F.max("asked").alias("asked"))
    rows = stored(rows.select("*", F.size("values").alias("dims"), F.xxhash64("values").alias("mark")), "scaled")
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    lanes, groups = max(1, -(-total // lane_rows)), max(1, -(-asked // group_queries))

    def blocks(df: DataFrame, cell: str, cells: int) -> DataFrame:
        dealt = df.withColumn(cell, F.pmod(F.xxhash64("id", "mark"), F.lit(cells)).cast("int"))
        schema = f"dims int, `{cell}` int, id binary, mark binary, width int, data binary"
        return stored(dealt.groupBy("dims", cell).applyInArrow(_packed(["dims", cell]), schema), cell)

    def met(df: DataFrame, cell: str, cells: int) -> DataFrame:
        return df.withColumn(cell, F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).groupBy("dims", "lane", "query_group")

    queries = met(blocks(rows.where("asked"), "query_group", groups), "lane", lanes)
    candidates = met(blocks(rows, "lane", lanes), "query_group", groups)
    found = queries.cogroup(candidates).applyInArrow(_searched(k), RESULT)
    by_query = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
