"""Nearest neighbours by adaptive dimension scan over inverted lists (operator 1).

Fit: centroids by k-means on the ``SAMPLE`` rows of smallest hash, a fixed number; as many lists
as the square root of the rows, ``MAX_LISTS`` at most. Every row is indexed: scaled to length 1,
rotated by a seeded random rotation and put into the list of its nearest centroid.

Probes: the fewest lists that hold ``RECALL`` of the sample's own nearest neighbours, found for
``TRIALS`` rows of the sample by brute force within it.

Scan: the vectors of a probed list are read in column blocks. After each block, the distance
so far, scaled up, is an estimate of the whole; a candidate is given up when the hypothesis
that it is nearer than the query's k-th best is rejected (``EPSILON`` sets the level). The others go on
to the next block. What is left at the end is measured on the original vectors in doubles.
The k-th best is known early: a query's own list is scanned first, a few rows and then more at
a time, and the other lists start from the distance that this gave.

A query that found fewer than k goes on to all lists that it had not probed.

Tasks: lists are cut into, or small ones put together as, cells of at most ``cell_rows`` vectors.
A query goes once to each cell with lists that it probes, as its original vector, with the numbers of these lists;
both sides are turned there. Queries of a list are dealt out in parts of at most as many,
so one hot region is many tasks. Centroids and rotation are broadcast: MAX_LISTS x dimensions doubles.

Defined results: vectors that are null, zero, hold null or non-finite components, or have
another dimension than most of the sample take no part, as query or candidate. Rows with the
query's own id are not its candidates. Ties go to the smaller id. Repeated rows of one id
count once; if their vectors differ, the one with the smallest hash counts. Fewer candidates than asked for:
all there are. Extra columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.store import settle, temporary

SAMPLE = 20_000
MAX_LISTS = 2048
#: Share of true neighbours that the probed lists shall hold, as measured on the sample.
RECALL = 0.97
TRIALS = 400
BLOCK = 16
EPSILON = 2.1
#: Bytes of vectors that a task holds of either side, about; and rows of a cell, at least.
CELL_BYTES, LEAST_CELL = 1 << 25, 1024
#: Cells that a table is cut into, about, while they are small.
CELLS = 200
#: Candidates that are judged together, at first and at most; and queries.
FIRST_ROWS, ROWS_AT_ONCE, QUERIES_AT_ONCE = 32, 512, 1024


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(points: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Spherical k-means; an emptied centroid starts anew at a random point."""
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(points, centers, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        size = np.linalg.norm(sums, axis=1)
        empty = size == 0
        sums[empty] = points[rng.integers(0, len(points), int(empty.sum()))]
        centers = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centers


def nearest(points: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centers of each point, nearest first."""
    out = np.empty((len(points), min(n, len(centers))), np.int64)
    for i in range(0, len(points), 2048):
        sims = -(points[i : i + 2048] @ centers.T)
        top = np.argpartition(sims, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < sims.shape[1] else np.tile(np.arange(sims.shape[1]), (len(sims), 1))
        order = np.take_along_axis(sims, top, 1).argsort(1, kind="stable")
        out[i : i + 2048] = np.take_along_axis(top, order, 1)
    return out


def probes_for(points: np.ndarray, centers: np.ndarray, k: int) -> int:
    """How many lists hold RECALL of the k nearest of each of the first TRIALS points."""
    asked = points[:TRIALS]
    sims = asked @ points.T
    sims[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(k, len(points) - 1)
    if k < 1:
        return len(centers)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    own = nearest(points, centers, 1)[:, 0]
    place = nearest(asked, centers, len(centers)).argsort(1)
    needed = np.sort(np.take_along_axis(place, own[top], 1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)) - 1)]) + 1


def matrix(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(vectors in doubles, their rows, dimension) of those that can take part."""
    lists = column.to_pylist() if column.null_count or column.flatten().null_count else None
    if lists is None:
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    else:
        lists = [x if x is not None and all(v is not None for v in x) else [] for x in lists]
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.array([v for x in lists for v in x], np.float64)
    if dim is None:
        full = sizes[sizes > 0]
        dim = int(np.bincount(full).argmax()) if len(full) else 0
    rows = np.flatnonzero(sizes == dim) if dim else np.zeros(0, np.int64)
    begins = np.append(0, np.cumsum(sizes))[rows]
    out = flat[begins[:, None] + np.arange(dim)] if len(rows) else np.zeros((0, max(dim, 1)))
    fit = np.isfinite(out).all(1) & (np.abs(out).max(1, initial=0) > 0)
    return out[fit], rows[fit], dim


def scaled(vectors: np.ndarray) -> np.ndarray:
    out = vectors / np.abs(vectors).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def scan(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, squared distance) of the candidates that were never given up, and how many were.

    ``best`` holds the k smallest squared distances of each query so far, smallest first, and is
    brought up to date.
    """
    dim, k = queries.shape[1], best.shape[1]
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    given_up, low, step = 0, 0, FIRST_ROWS
    while low < len(vectors):
        part, part_ids = vectors[low : low + step], ids[low : low + step]
        for first in range(0, len(queries), QUERIES_AT_ONCE):
            asked, top = queries[first : first + QUERIES_AT_ONCE], best[first : first + QUERIES_AT_ONCE]
            limit = top[:, -1]
            bound = lambda to: to / dim * (1 + epsilon / math.sqrt(to)) ** 2 if to < dim else 1.0
            at = min(dim, BLOCK)
            a, b = asked[:, :at], part[:, :at]
            grid = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
            other = query_ids[first : first + QUERIES_AT_ONCE, None] != part_ids
            q, v = np.nonzero(other & (grid <= (bound(at) * limit + 1e-5)[:, None]))
            given_up += int(other.sum()) - len(q) if at < dim else 0
            sums = grid[q, v]
            while at < dim:
                to = min(dim, at + BLOCK)
                gap = asked[q, at:to] - part[v, at:to]
                sums = sums + (gap * gap).sum(1)
                on = sums <= bound(to) * limit[q] + 1e-5
                given_up += int((~on).sum()) if to < dim else 0
                q, v, sums, at = q[on], v[on], sums[on], to
            sums = np.maximum(sums, 0)
            kept.append((q + first, v + low, sums))
            full = np.full((len(asked), k + len(part)), np.inf, np.float32)
            full[:, :k] = top
            full[q, k + v] = sums
            top[:] = np.sort(np.partition(full, k - 1, axis=1)[:, :k], axis=1)
        low, step = low + step, min(2 * step, ROWS_AT_ONCE)
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), given_up
    q, v, d = (np.concatenate(x) for x in zip(*kept, strict=True))
    on = d <= best[q, -1] + 1e-5
    return q[on], v[on], d[on], given_up


def scan_lists(queries: np.ndarray, query_ids: np.ndarray, probed: list[np.ndarray], bounds: np.ndarray, vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, row) of what is left after scanning the lists that each query probes, one after the other, and how many were given up.

    ``bounds`` are squared distances within which a query has k candidates elsewhere.
    """
    best = np.repeat(bounds.astype(np.float32)[:, None], k, axis=1)
    place = np.repeat(np.arange(len(probed)), [len(x) for x in probed])
    wanted = np.concatenate(probed) if len(probed) else np.zeros(0, np.int64)
    kept, given_up = [], 0
    for name in np.unique(lists):
        rows, asks = np.flatnonzero(lists == name), place[wanted == name]
        top = best[asks]
        q, v, d, gone = scan(queries[asks], query_ids[asks], vectors[rows], ids[rows], top, epsilon)
        best[asks] = top
        given_up += gone
        kept.append((asks[q], rows[v], d))
    q, v, d = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64),) * 3
    on = d <= best[q, -1] + 1e-5
    return q[on], v[on], given_up


def exact(x: np.ndarray) -> np.ndarray:
    """Rows in doubles, scaled by powers of two, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows scaled by ``exact``, in doubles, each by itself, so that equal rows give equal numbers."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Index:
    """Lists of all rows, and what queries need to find theirs."""

    def __init__(self, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 5, probes: int | None = None, k: int = 5):
        slim = self._slim(rows, id_col, vector_col)
        self.seed, spark = seed, rows.sparkSession
        self.total = slim.count()
        sample = slim.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select(F.col("vector").cast("array<double>")).toArrow().column(0).combine_chunks()
        if isinstance(sample, pa.ChunkedArray):
            sample = pa.concat_arrays(sample.chunks) if sample.num_chunks else pa.array([], pa.list_(pa.float64()))
        found, _, self.dim = matrix(sample, None)
        self.empty = not len(found)
        if self.empty:
            return
        turn = rotation(self.dim, seed)
        n_lists = max(1, min(MAX_LISTS, round(math.sqrt(self.total)), len(found)))
        centers = kmeans(scaled(found) @ turn, n_lists)
        self.probes = min(n_lists, probes or probes_for(scaled(found) @ turn, centers, k))
        self.n_lists = len(centers)
        self.shared = spark.sparkContext.broadcast((self.dim, turn, centers))
        placed = self._placed(self._single(slim), 1).select(F.get("lists", F.lit(0)).alias("list"), "vec_id", "vector")
        self.table = settle(placed, "ann-lists")
        # one row a list: MAX_LISTS at most
        self.sizes = {r["list"]: r["n"] for r in self.table.groupBy("list").agg(F.count("*").alias("n")).collect()}

    @staticmethod
    def _slim(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        """Vectors stay floats if they are: these are exact as doubles, and half as long."""
        kind = "array<float>" if rows.select(F.col(vector_col).alias("v")).schema["v"].dataType.simpleString() == "array<float>" else "array<double>"
        return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector")).where("vec_id is not null and vector is not null")

    def _single(self, slim: DataFrame) -> DataFrame:
        """One row of each id. Only ids that are repeated, found without their vectors, meet their rows again."""
        again = settle(slim.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "ann-repeated")
        if not again.limit(1).count():
            return slim
        some = slim.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("vector").alias("h"), "vector")).alias("first"))
        return slim.join(again, "vec_id", "left_anti").unionByName(some.select("vec_id", "first.vector"))

    def _placed(self, rows: DataFrame, lists: int) -> DataFrame:
        """(vec_id, vector, lists) of the rows that can take part: the numbers of their nearest lists, nearest first."""
        shared = self.shared

        def work(batches):
            dim, turn, centers = shared.value
            for batch in batches:
                vectors, at, _ = matrix(batch.column(1), dim)
                if len(at):
                    near = nearest(scaled(vectors) @ turn, centers, lists).astype(np.int32)
                    rows = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.int32()))], ["vec_id", "vector", "lists"])

        return rows.mapInArrow(work, f"vec_id long, vector {rows.schema['vector'].dataType.simpleString()}, lists array<int>")

    def _deal(self, per_list: dict[int, int]) -> list[tuple[int, int, int, int]]:
        """(list, first cell, cells, parts of its queries) of each list; small lists share a cell."""
        most = max(LEAST_CELL, CELL_BYTES // (8 * self.dim))
        goal = max(LEAST_CELL, min(most, self.total // CELLS))
        out, cell, room, shared = [], 0, 0, []
        for name, n in sorted(self.sizes.items()):
            if n > goal:
                parts = -(-n // goal)
                out.append((name, cell, parts, -(-per_list.get(name, 0) // most)))
                cell, room = cell + parts, 0
                continue
            if n > room:
                room, cell = goal, cell + 1
            room -= n
            shared.append((name, cell - 1, per_list.get(name, 0)))
        asks: dict[int, int] = {}
        for _, at, n in shared:
            asks[at] = max(asks.get(at, 0), n)
        return out + [(name, at, 1, -(-asks[at] // most)) for name, at, _ in shared]

    def _scan(self, asks: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score): the k nearest of each cell to each of (query_id, vector, bound, lists)."""
        spark = asks.sparkSession
        # a row a list
        counts = {r["list"]: r["n"] for r in asks.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect()}
        plan = [d for d in self._deal(counts) if counts.get(d[0])]
        if not plan:
            return spark.createDataFrame([], "query_id long, vec_id long, score double")
        deal = F.broadcast(spark.createDataFrame(plan, "list int, first int, cells int, parts int"))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        vectors = self.table.join(deal, "list").select("list", "vec_id", "vector", (F.col("first") + part("vec_id", "cells")).alias("cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        n_lists, shared, numbers = self.n_lists, self.shared, np.zeros((self.n_lists, 3), np.int64)
        for name, first, cells, parts in plan:
            numbers[name] = first, cells, parts
        numbers = spark.sparkContext.broadcast(numbers)

        def sent(batches):
            """Each query once to each cell that has lists of its, with these lists."""
            for batch in batches:
                lists = batch.column(3)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                first, cells, parts = numbers.value[flat].T
                one = np.repeat(np.arange(len(flat)), cells)
                cell = first[one] + np.arange(len(one)) - np.repeat(np.cumsum(cells) - cells, cells)
                order = np.lexsort((flat[one], cell, row[one]))
                row, cell, flat, parts = row[one][order], cell[order], flat[one][order], parts[one][order]
                if not len(row):
                    continue
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])))
                rows = batch.take(pa.array(row[new]))
                taken = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(cell[new].astype(np.int32)), pa.array(parts[new].astype(np.int32)), rows.column(0), rows.column(1), rows.column(2), taken], ["cell", "parts", "query_id", "vector", "bound", "lists"])

        kind = self.table.schema["vector"].dataType.simpleString()
        right = asks.select("query_id", F.col("vector").cast(kind).alias("vector"), "bound", "lists").mapInArrow(sent, f"cell int, parts int, query_id long, vector {kind}, bound double, lists array<int>")
        key = F.struct("cell", "part").alias("key")
        right = right.select("*", part("query_id", "parts").alias("part")).select(key, "query_id", "vector", "bound", "lists").groupBy("key")
        left = vectors.select(key, "list", "vec_id", "vector").groupBy("key")

        def work(vectors: pa.Table, asks: pa.Table) -> pa.Table:
            dim, turn, _ = shared.value
            rows = lambda t: t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            ids, query_ids = vectors.column("vec_id").to_numpy(), asks.column("query_id").to_numpy()
            q = v = np.zeros(0, np.int64)
            scores = np.zeros(0)
            if len(ids) and len(query_ids):
                originals, asked = exact(rows(vectors)), exact(rows(asks))
                turned = [(scaled(x) @ turn).astype(np.float32) for x in (asked, originals)]
                q, v, _ = scan_lists(turned[0], query_ids, [np.asarray(x) for x in asks.column("lists").to_pylist()], asks.column("bound").to_numpy(), turned[1], ids, vectors.column("list").to_numpy(), k)
                scores = np.concatenate([cosines(originals[v[i : i + 65_536]], asked[q[i : i + 65_536]]) for i in range(0, max(1, len(q)), 65_536)])
                order = np.lexsort((ids[v], -scores, q))
                q, v, scores = q[order], v[order], scores[order]
                count = np.bincount(q, minlength=len(query_ids))
                on = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) < k
                q, v, scores = q[on], v[on], scores[on]
            return pa.table([pa.array(query_ids[q], pa.int64()), pa.array(ids[v], pa.int64()), pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"])

        return left.cogroup(right).applyInArrow(work, "query_id long, vec_id long, score double")

    def search(self, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score) of the k nearest of each query, its own id left out."""
        spark = queries.sparkSession
        if self.empty:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        with temporary() as keep:
            return keep(*self._searched(queries, k, id_col, vector_col))

    def _searched(self, queries: DataFrame, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, ...]:
        asked = self._placed(self._single(self._slim(queries, id_col, vector_col)), self.probes)
        asked = settle(asked.withColumnRenamed("vec_id", "query_id"), "ann-queries")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = lambda found: found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
        # squared distances of unit vectors are 2 - 2 x cosine; k of a query bound all that may still come
        full = F.when(F.count("*") >= k, F.greatest(2 - 2 * F.min("score"), F.lit(0.0)) + 1e-6).otherwise(F.lit(float("inf")))
        own = settle(best(self._scan(asked.select("query_id", "vector", F.lit(float("inf")).alias("bound"), F.slice("lists", 1, 1).alias("lists")), k)), "ann-own")
        bounds = own.groupBy("query_id").agg(full.alias("bound"))
        rest = asked.join(bounds, "query_id", "left").select("query_id", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), F.slice("lists", 2, self.n_lists).alias("lists"))
        found = own.drop("rank")
        if self.probes > 1:
            found = found.unionByName(self._scan(rest, k))
        found = settle(best(found), "ann-found")
        # whoever has too few reads all lists that are left
        counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
        few = asked.join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k)
        left = F.array_except(F.sequence(F.lit(0), F.lit(self.n_lists - 1)), F.col("lists"))
        few = settle(few.select("query_id", "vector", F.lit(float("inf")).alias("bound"), left.alias("lists")).where("size(lists) > 0"), "ann-few")
        if few.limit(1).count():
            return best(found.drop("rank").unionByName(self._scan(few, k))), found, few
        return (found,)
