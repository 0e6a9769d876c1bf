"""Exact nearest-neighbour search with a KD-tree in every shard.

Vectors are dealt to cells by median planes found on a sample, and a cell to as
many shards of bounded size as its number of vectors asks for. Each shard becomes one file in
the shared folder: a KD-tree with median splits, the tight bounding box of every node, and
the vectors in leaf order; the boxes of a cell's shards are a file as well. Queries of one cell
travel together: from one heap over all cells the box nearest to them is taken
first, be it a cell's, a shard's or a node's, by the distance from query to box; the distance of the k-th
neighbour found so far goes with them and shuts out everything that is farther,
whole cells and shards included. Only mapped files are read, queries are never copied per shard.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docparity.llm.common import cut, new_folder, open_mapped, write_whole

TOP = 10
SHARD_VECTORS = 8192
#: Cells at most; their boxes are all that is sent with the tasks. More vectors give more shards a cell.
MOST_CELLS = 4096
LEAF = 128
#: Queries that go through the trees together.
TOGETHER = 64
#: Vectors the planes between cells are found on; they decide how even the cells are, not what is found.
PLANE_SAMPLE = 20_000


def median_planes(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """(dimension, threshold, left, right) of each inner node, the root first; a child below 0 is leaf ``-1 - child``. At most ``leaves`` leaves."""
    nodes: list[tuple[int, float, int, int]] = []
    made = 0

    def split(part: np.ndarray, n: int) -> int:
        nonlocal made
        spread = np.ptp(part, axis=0) if len(part) > 1 else np.zeros(points.shape[1])
        if n <= 1 or len(part) < 2 or not spread.max() > 0:
            made += 1
            return -made
        dim = int(spread.argmax())
        values = np.sort(part[:, dim])
        at = float(values[len(values) * (n // 2) // n])
        if at == values[0]:
            at = float(values[values > values[0]][0])
        me = len(nodes)
        nodes.append((dim, at, 0, 0))
        left = part[:, dim] < at
        a, b = split(part[left], n // 2), split(part[~left], n - n // 2)
        nodes[me] = (dim, at, a, b)
        return me

    split(points, leaves)
    return nodes


def leaf_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))] if nodes else []
    while todo:
        node, rows = todo.pop()
        if node < 0:
            out[rows] = -1 - node
        elif len(rows):
            dim, at, a, b = nodes[node]
            left = points[rows, dim] < at
            todo += [(a, rows[left]), (b, rows[~left])]
    return out


def build_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points by leaf; per node (from, to, left, right) with -1 for no child; tight lower and upper corners."""
    order = np.arange(len(points))
    nodes: list[list[int]] = []
    low: list[np.ndarray] = []
    high: list[np.ndarray] = []
    todo = [(0, len(points), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        me = len(nodes)
        part = points[order[lo:hi]]
        nodes.append([lo, hi, -1, -1])
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        if parent >= 0:
            nodes[parent][2 + side] = me
        dim = int((high[-1] - low[-1]).argmax())
        if hi - lo > leaf and high[-1][dim] > low[-1][dim]:
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(part[:, dim], mid, kind="introselect")]
            todo += [(lo + mid, hi, me, 1), (lo, lo + mid, me, 0)]
    return order, np.array(nodes, np.int64), np.array(low), np.array(high)


class Shard:
    """A shard's file: header, nodes, boxes, vectors in leaf order, ids."""

    def __init__(self, data: np.ndarray):
        size = int.from_bytes(data[:8].tobytes(), "little")
        n, dim, n_nodes = json.loads(data[8 : 8 + size].tobytes())
        at = 8 + size

        def take(dtype, *shape: int) -> np.ndarray:
            nonlocal at
            count = int(np.prod(shape)) * 8
            out = data[at : at + count].view(dtype).reshape(shape)
            at += count
            return out

        self.nodes = take(np.int64, n_nodes, 4)
        self.low, self.high = take(np.float64, n_nodes, dim), take(np.float64, n_nodes, dim)
        self.points, self.ids = take(np.float64, n, dim), take(np.int64, n)

    @staticmethod
    def pack(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes, and corners of the whole shard's box."""
        order, nodes, low, high = build_tree(points, leaf)
        head = json.dumps([len(points), points.shape[1], len(nodes)]).encode()
        head = head.ljust(-(-len(head) // 8) * 8, b" ")
        parts = [nodes, low, high, points[order], ids[order]]
        return len(head).to_bytes(8, "little") + head + b"".join(np.ascontiguousarray(p).tobytes() for p in parts), low[0], high[0]


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to a box."""
    gap = np.maximum(np.maximum(low - queries, queries - high), 0.0)
    return np.einsum("ij,ij->i", gap, gap)


class Best:
    """The k best neighbours of each query so far, by (distance, id)."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.ids, self.k = queries, ids, k
        self.norm = np.einsum("ij,ij->i", queries, queries)
        self.d = np.full((len(queries), k), np.inf)
        self.n = np.full((len(queries), k), np.iinfo(np.int64).max)

    @property
    def kth(self) -> np.ndarray:
        return self.d[:, -1]

    def offer(self, rows: np.ndarray, points: np.ndarray, ids: np.ndarray) -> None:
        norm = np.einsum("ij,ij->i", points, points)
        near = self.norm[rows, None] + norm[None, :] - 2.0 * (self.q[rows] @ points.T)
        # the product is only good to a rounding error: what may be near enough is measured again
        slack = 1e-12 * (self.norm[rows, None] + norm[None, :]) + 1e-300
        r, c = np.nonzero((near <= self.kth[rows, None] + slack) & (ids[None, :] != self.ids[rows, None]))
        if not len(r):
            return
        hit = np.unique(r)
        diff = self.q[rows[r]] - points[c]
        all_r = np.concatenate([np.repeat(hit, self.k), r])
        all_d = np.concatenate([self.d[rows[hit]].ravel(), np.einsum("ij,ij->i", diff, diff)])
        all_n = np.concatenate([self.n[rows[hit]].ravel(), ids[c]])
        order = np.lexsort((all_n, all_d, all_r))
        all_r = all_r[order]
        first = np.flatnonzero(np.diff(all_r, prepend=-1))
        rank = np.arange(len(all_r)) - np.repeat(first, np.diff(np.append(first, len(all_r))))
        keep = order[rank < self.k]
        self.d[rows[hit]] = all_d[keep].reshape(-1, self.k)
        self.n[rows[hit]] = all_n[keep].reshape(-1, self.k)


@lru_cache(maxsize=64)
def _open(path: str) -> Shard:
    return Shard(open_mapped(path))


@lru_cache(maxsize=256)
def _boxes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, lower and upper corners of a cell's shards."""
    data = open_mapped(path)
    n, dim = (int(x) for x in data[:16].view(np.int64))
    corners = data[16 + 8 * n :].view(np.float64).reshape(2, n, dim)
    return data[16 : 16 + 8 * n].view(np.int64), corners[0], corners[1]


def search(queries: np.ndarray, ids: np.ndarray, home: int, folder: str, cells: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> Best:
    """Best-first over all shards for queries that lie close together. cells: numbers, lower and upper corners of the cells."""
    best = Best(queries, ids, k)
    heap: list[tuple[float, bool, int, int, int]] = []  # bound, not at home, cell, shard (-1: the cell itself), node

    def offer(at: tuple[int, int, int], low: np.ndarray, high: np.ndarray) -> None:
        bounds = box_bounds(queries, low, high)
        bounds = bounds[bounds <= best.kth]
        if bounds.size:
            heapq.heappush(heap, (float(bounds.min()), at[0] != home, *at))

    for cell, low, high in zip(cells[0].tolist(), *cells[1:]):
        offer((cell, -1, 0), low, high)
    while heap:
        bound, _, cell, number, node = heapq.heappop(heap)
        if bound > best.kth.max():
            break
        if number < 0:
            for shard, low, high in zip(*_boxes(f"{folder}/{cell}.boxes")):
                offer((cell, int(shard), 0), low, high)
            continue
        shard = _open(f"{folder}/{cell}-{number}.kd")
        live = np.flatnonzero(box_bounds(queries, shard.low[node], shard.high[node]) <= best.kth)
        if not live.size:
            continue
        lo, hi, a, b = shard.nodes[node].tolist()
        if a < 0:
            best.offer(live, shard.points[lo:hi], shard.ids[lo:hi])
        else:
            for child in (a, b):
                offer((cell, number, child), shard.low[child], shard.high[child])
    return best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _dealt(ids: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """A shard below ``shards`` for each id, the same on every machine."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % shards.astype(np.uint64)).astype(np.int64)


def _sound(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    given = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    given = given.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return given.groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = TOP, shard_vectors: int = SHARD_VECTORS, leaf: int = LEAF, most_cells: int = MOST_CELLS, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k nearest of ``vectors`` to each query, by Euclidean distance, then id. Exact.

    ``queries`` has the columns of ``vectors``, which are the queries if it is left out; a vector
    with a query's id is no neighbour of it. Rows without id or vector, with an empty vector, nulls, NaN or infinities in it, and
    vectors whose length is not the most frequent one (of equally frequent ones
    the longest) take no part. Of rows with one id the least vector takes part.
    With fewer than k others all are given. Other columns are not read. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, rank int, neighbor_id long, distance double"
    given = cut(_sound(vectors, key, vector))
    common = given.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim, n = common["dim"], common["count"]
    given = given.where(F.size("v") == dim)
    asked = given if queries is None else _sound(queries, key, vector).where(F.size("v") == dim)
    sample = given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PLANE_SAMPLE).select("v").toArrow().column("v").combine_chunks()
    planes = median_planes(_matrix(sample, dim), min(most_cells, -(-n // shard_vectors)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(leaf_of(_matrix(batch.column("v"), dim), planes)), batch.column("vec_id"), batch.column("v")], ["cell", "vec_id", "v"])

    routed = "cell long, vec_id long, v array<double>"
    placed = given.mapInArrow(route, routed)
    # at most most_cells rows
    sizes = np.ones(most_cells, np.int64)
    for r in placed.groupBy("cell").count().collect():
        sizes[r["cell"]] = -(-r["count"] // shard_vectors)
    folder = new_folder(spark, "kd-shards")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in route(batches):
            shard = _dealt(batch.column("vec_id").to_numpy(), sizes[batch.column("cell").to_numpy()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])

    def write(key, table):
        table = table.combine_chunks()
        ids, points = table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks(), dim)
        order = np.argsort(ids)
        data, low, high = Shard.pack(points[order], ids[order], leaf)
        cell, shard = (x.as_py() for x in key)
        write_whole(f"{folder}/{cell}-{shard}.kd", iter([data]))
        return pa.table({"cell": pa.array([cell], pa.int64()), "shard": pa.array([shard], pa.int64()), "low": pa.array([low.tolist()]), "high": pa.array([high.tolist()])})

    def write_boxes(key, table):
        table = table.combine_chunks()
        low, high = (_matrix(table.column(c).combine_chunks(), dim) for c in ("low", "high"))
        head = np.array([len(low), dim], np.int64)
        write_whole(f"{folder}/{key[0].as_py()}.boxes", iter([head.tobytes(), table.column("shard").to_numpy().tobytes(), low.tobytes(), high.tobytes()]))
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "low": pa.array([low.min(axis=0).tolist()]), "high": pa.array([high.max(axis=0).tolist()])})

    corners = "low array<double>, high array<double>"
    written = given.mapInArrow(deal, f"{routed}, shard long").groupBy("cell", "shard").applyInArrow(write, f"cell long, shard long, {corners}")
    found = cut(written.groupBy("cell").applyInArrow(write_boxes, f"cell long, {corners}")).toArrow().combine_chunks()
    # one box a cell
    cells = (found.column("cell").to_numpy(), _matrix(found.column("low").combine_chunks(), dim), _matrix(found.column("high").combine_chunks(), dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, points, home = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dim), batch.column("cell").to_numpy()
            for cell in np.unique(home).tolist():
                mine = np.flatnonzero(home == cell)
                for lo in range(0, len(mine), TOGETHER):
                    rows = mine[lo : lo + TOGETHER]
                    best = search(points[rows], ids[rows], cell, folder, cells, k)
                    row, col = np.nonzero(np.isfinite(best.d))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(best.ids[row]), pa.array((col + 1).astype(np.int32)), pa.array(best.n[row, col]), pa.array(np.sqrt(best.d[row, col]))], ["vec_id", "rank", "neighbor_id", "distance"]
                    )

    near = asked.mapInArrow(route, routed)
    return near.repartitionByRange(int(min(10_000, max(8, -(-n // 2048)))), "cell", "vec_id").mapInArrow(run, schema)


def top_k_sql(k: int = TOP, table: str = "embeddings", queries: str = "vec_id % 50 = 0") -> str:
    """DuckDB SQL for :func:`top_k`, every pair of a query and a vector measured."""
    return f"""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM {table}),
    p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS distance FROM (SELECT * FROM e WHERE {queries}) a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM p)
    SELECT vec_id, rank::INTEGER AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= {k}"""
