"""Operator 8, approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to a cell: the whole parts of PROJECTIONS random
projections over a width.  A neighbour at distance d differs by d times a
normal variable in each projection, so the chance that it lies in a cell
near the query's own is a product of normal probabilities.  Each query
visits the cells of a table in falling order of that chance, until the tables together
should hold a neighbour with probability TARGET.  Rows meet queries by cell,
cells with many rows or queries in parts; distances of the candidates are exact.

The width follows the distances of a bounded sample of queries, and is doubled
while that brings hardly more rows into the visited cells, as between clusters:
it then costs nothing to miss fewer neighbours.  A query that
found too few rows, or whose k-th distance is so large that its visited cells
would have missed such a neighbour too often, is asked again with wider cells,
and at last of all rows in blocks, so outliers keep their neighbours.
"""

from __future__ import annotations

from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narralake.llm.common import keep, table
from narralake.llm.vectors import BLOCK, EVERY, GROUP, best_pairs, matrix, meet, n_blocks, ranked, usable

K = 10
TABLES, PROJECTIONS = 3, 4
WIDTH = 2.0  # of a cell, in distances of the sample
TARGET = 0.97  # probability that a neighbour at the sample's distance is in a visited cell
LEAST = 0.9  # of that probability at a query's own k-th distance; below, the query is asked again
PILOTS = 128  # queries of the sample, each compared with all rows
SAMPLE = 1024  # rows, about, whose distances from the pilots say what wider cells cost
MORE = 0.005  # share of all rows that a query may meet more for wider cells
DOUBLINGS = 6  # of the sample's distance, at most
WIDER = 2.0  # the second round's distance, in the sample's greatest
_OFFSETS = np.stack(np.meshgrid(*[np.arange(-1, 2)] * PROJECTIONS, indexing="ij"), -1).reshape(-1, PROJECTIONS)
_phi = np.vectorize(lambda z: 0.5 * (1 + erf(z / 2**0.5)), otypes=[float])


def exact(
    q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest (query position, row position, distance) of each query.

    A product of matrices preselects, with room for its rounding; the distances
    of what stays are sums of squared differences.
    """
    square_q, square_x = (q**2).sum(1), (x**2).sum(1)
    rough = square_q[:, None] + square_x[None] - 2 * q @ x.T
    open_ = q_ids[:, None] != x_ids[None]
    rough[~open_] = np.inf
    room = 1e-9 * (square_q + square_x.max(initial=0.0))
    if rough.shape[1] > k:
        bar = np.partition(rough, k - 1, axis=1)[:, k - 1] + room
    else:
        bar = np.full(len(q), np.finfo(float).max)
    at_q, at_x = np.nonzero((rough <= bar[:, None]) & open_)
    out = np.concatenate(
        [np.zeros(0)]
        + [
            np.sqrt(((q[at_q[a : a + 65536]] - x[at_x[a : a + 65536]]) ** 2).sum(1))
            for a in range(0, len(at_q), 65536)
        ]
    )
    top = best_pairs(at_q, out, x_ids[at_x], k)
    return at_q[top], at_x[top], out[top]


class Hashes:
    """The tables of one width: cells of vectors, and the cells that a query visits."""

    def __init__(self, dim: int, distance: float):
        rng = np.random.default_rng(8)
        self.distance, self.width = distance, WIDTH * distance
        self.lines = rng.standard_normal((TABLES, dim, PROJECTIONS))
        self.shift = rng.random((TABLES, 1, PROJECTIONS)) * self.width
        self.mul = rng.integers(1, 2**62, (TABLES, PROJECTIONS), dtype=np.int64) | 1

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections in widths, by table, vector and line."""
        return (x[None] @ self.lines + self.shift) / self.width

    def key(self, table_: int, whole: np.ndarray) -> np.ndarray:
        """A cell's name; two cells of one name are one larger cell."""
        with np.errstate(over="ignore"):
            return (whole.astype(np.int64) * self.mul[table_]).sum(-1) * np.int64(TABLES) + table_

    def cells(self, x: np.ndarray) -> np.ndarray:
        whole = np.floor(self.places(x))
        return np.stack([self.key(t, whole[t]) for t in range(TABLES)], 1)

    def chances(self, q: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Chance, by table, query and cell around its own, that a row at the distance is in it."""
        at = self.places(q)
        part = (at - np.floor(at))[..., None]
        edges = np.arange(-1, 3) - part  # of the cell before, its own and the next
        below = _phi(edges * self.width / np.maximum(distance, 1e-300)[None, :, None, None])
        each = np.diff(below, axis=-1)  # table, query, line, offset
        out = np.ones((*at.shape[:2], len(_OFFSETS)))
        for j in range(PROJECTIONS):
            out *= each[:, :, j, _OFFSETS[:, j] + 1]
        return out

    def visits(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which cells are visited, by table, query and offset; their names), best chances first until they suffice."""
        chance = self.chances(q, np.full(len(q), self.distance))
        order = np.argsort(-chance, axis=-1, kind="stable")
        sums = np.cumsum(np.take_along_axis(chance, order, -1), axis=-1)
        enough = 1 - (1 - TARGET) ** (1 / TABLES)
        taken = np.concatenate([np.zeros((*sums.shape[:2], 1)), sums[..., :-1]], -1) < enough
        chosen = np.zeros(chance.shape, bool)
        np.put_along_axis(chosen, order, taken, -1)
        whole = np.floor(self.places(q))
        names = np.stack([self.key(t, whole[t][:, None] + _OFFSETS[None]) for t in range(TABLES)])
        return chosen, names

    def reached(self, q: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Chance that the visited cells hold a row at each query's distance."""
        held = np.where(self.visits(q)[0], self.chances(q, distance), 0.0).sum(-1)
        return 1 - np.prod(1 - held, axis=0)


def widened(distance: float, q: np.ndarray, x: np.ndarray) -> float:
    """The distance, doubled as long as queries like q then meet hardly more rows like x."""
    far = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T, 0.0))
    far = np.quantile(far, np.linspace(0, 1, 17)[1:], axis=1).T if len(x) else far
    each = np.repeat(q, far.shape[1], axis=0)

    def met(d: float) -> float:
        return float(Hashes(q.shape[1], d).reached(each, far.ravel()).mean()) if far.size else 1.0

    least, best = met(distance), distance
    for times in range(1, DOUBLINGS + 1):
        if met(distance * 2**times) > least + MORE:
            break
        best = distance * 2**times
    return best


def _in_blocks(rows: DataFrame, asked: DataFrame, n: int, n_asked: int, dim: int, k: int) -> DataFrame:
    """Exact: every group of queries meets every block of rows."""
    blocks, groups = n_blocks(n, BLOCK), n_blocks(n_asked, GROUP)
    dealt = rows.withColumn("_block", F.pmod(F.hash("_n"), F.lit(blocks)))
    grouped = asked.withColumn("_group", F.pmod(F.hash("_id"), F.lit(groups)))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(left.num_rows, np.int64)
        return _best(left, none, right, np.zeros(right.num_rows, np.int64), dim, k)

    return meet(grouped, dealt, blocks, groups, kernel, _FOUND)


_FOUND = "query_id long, vec_id long, _n long, score double"


def _best(left: pa.Table, q_cell: np.ndarray, right: pa.Table, x_cell: np.ndarray, dim: int, k: int) -> pa.Table:
    """Each query's k nearest among the rows that share a cell with it."""
    q_ids, x_ids, x_n = left["_id"].to_numpy(), right["_id"].to_numpy(), right["_n"].to_numpy()
    q, x = matrix(left["_v"], dim), matrix(right["_v"], dim)
    at_q, at_x = np.argsort(q_cell, kind="stable"), np.argsort(x_cell, kind="stable")
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    both = np.intersect1d(q_cell, x_cell)
    edges = [np.searchsorted(c[o], both, side) for c, o in ((q_cell, at_q), (x_cell, at_x)) for side in ("left", "right")]
    for a, b, c, d in zip(*(e.tolist() for e in edges), strict=True):
        rows = at_x[c:d]
        for start in range(a, b, 128):
            mine = at_q[start : min(b, start + 128)]
            i, j, far = exact(q[mine], q_ids[mine], x[rows], x_ids[rows], k)
            found.append((q_ids[mine][i], rows[j], far))
    ids, row, far = (np.concatenate(c) for c in zip(*found, strict=True))
    _, once = np.unique(np.stack([ids, x_n[row]]), axis=1, return_index=True)
    ids, row, far = ids[once], row[once], far[once]
    top = best_pairs(ids, far, x_ids[row], k)
    cols = (ids[top], x_ids[row[top]], x_n[row[top]], far[top])
    return pa.table(dict(zip(("query_id", "vec_id", "_n", "score"), cols, strict=True)))


def _by_cells(rows: DataFrame, asked: DataFrame, n: int, hashes: Hashes, dim: int, k: int) -> DataFrame:
    """Rows meet the queries that visit their cells."""
    buckets = n_blocks(TABLES * n, BLOCK)

    def cells(v: pa.Array) -> pa.Array:
        return pa.array(list(hashes.cells(matrix(v, dim))), pa.list_(pa.int64()))

    def visited(v: pa.Array) -> pa.Array:
        chosen, names = hashes.visits(matrix(v, dim))
        return pa.array([names[:, i][chosen[:, i]] for i in range(len(v))], pa.list_(pa.int64()))

    held = rows.withColumn("_cell", F.explode(F.arrow_udf(cells, "array<long>")("_v")))
    asks = keep(asked.withColumn("_cells", F.arrow_udf(visited, "array<long>")("_v")), "visits")
    asks = asks.select("_id", "_v", F.explode(F.array_distinct("_cells")).alias("_cell"))
    # Cells of many rows are split by row, and cells of many queries by query.
    sizes = held.groupBy("_cell").agg(F.count("*").alias("_size")).where(F.col("_size") > BLOCK)
    asking = asks.groupBy("_cell").agg(F.count("*").alias("_asks")).where(F.col("_asks") > GROUP)
    hot = keep(sizes.join(asking, "_cell", "full"), "hot")

    def parts(column: str, size: int) -> Column:
        return F.ceil(F.coalesce(F.col(column), F.lit(1)) / size).cast("int")

    def dealt(df: DataFrame, own: str, mine: Column, theirs: Column, names: tuple[str, str]) -> DataFrame:
        split = df.join(hot, "_cell", "left").withColumn(names[0], F.pmod(F.hash(own), mine))
        return split.withColumn(names[1], F.explode(F.sequence(F.lit(0), theirs - 1))).withColumn(
            "_bucket", F.pmod(F.xxhash64("_cell", "_part", "_share"), F.lit(buckets))
        )

    of_rows, of_asks = parts("_size", BLOCK), parts("_asks", GROUP)
    left = dealt(asks, "_id", of_asks, of_rows, ("_share", "_part")).select("_id", "_v", "_cell", "_bucket", "_part", "_share")
    right = dealt(held, "_n", of_rows, of_asks, ("_part", "_share")).select(
        "_id", "_n", "_v", "_cell", "_bucket", "_part", "_share"
    )

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        # A part of a cell meets its own queries only; which part is one more digit of the cell.
        def cell(t: pa.Table) -> np.ndarray:
            part, share = t["_part"].to_numpy().astype(np.int64), t["_share"].to_numpy().astype(np.int64)
            return t["_cell"].to_numpy() ^ ((part << 20 | share) * np.int64(0x9E3779B97F4A7C1))

        with np.errstate(over="ignore"):
            return _best(left, cell(left), right, cell(right), dim, k)

    return left.groupBy("_bucket").cogroup(right.groupBy("_bucket")).applyInArrow(kernel, _FOUND)


def nearest(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of each query's k nearest found.

    Vectors that are null, all zero or hold a null or non-finite component and
    rows with a null id take no part; a shorter vector counts as ending in
    zeros.  Rows with the query's own id are no candidates; a repeated query id
    is asked once, a repeated row is found as often as it occurs.  Ties go to
    the smaller id.  Only the id and the vector are read, so other columns
    cannot clash; empty tables give an empty result.
    """
    def clean(df: DataFrame) -> DataFrame:
        some = F.exists(F.col(vector), lambda x: x != 0)
        return df.where(usable(F.col(vector)) & some & F.col(key).isNotNull()).select(
            F.col(key).cast("long").alias("_id"), F.col(vector).alias("_v")
        )

    rows = keep(clean(vectors).withColumn("_n", F.monotonically_increasing_id()), "rows")
    asked = keep(clean(queries).dropDuplicates(["_id"]), "queries")
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("_v")), F.lit(0))).first()
    dim = max(1, dim, asked.agg(F.coalesce(F.max(F.size("_v")), F.lit(0))).first()[0])
    n_asked = asked.count()
    pilots = asked.orderBy(F.xxhash64("_id"), "_id").limit(PILOTS)
    far = ranked(_in_blocks(rows, pilots, n, PILOTS, dim, k), k, F.asc("score"))
    sample = np.array([r.far for r in far.groupBy("query_id").agg(F.max("score").alias("far")).collect()])
    results, widest, middle = [], float(sample.max(initial=0.0)), float(np.median(sample)) if len(sample) else 0.0
    if middle > 0:
        some = rows.where(F.pmod(F.xxhash64("_n", F.lit(8)), F.lit(-(-n // SAMPLE))) == 0)
        middle = widened(middle, *(matrix(df.select("_v").toArrow()["_v"], dim) for df in (pilots, some)))
    for distance in [middle, WIDER * widest] if widest > 0 else []:
        if distance <= 0:
            continue
        hashes = Hashes(dim, distance)
        found = keep(_best_of(_by_cells(rows, asked, n, hashes, dim, k), k), "found")
        judged = keep(_judged(found, asked, hashes, dim, k), "judged")
        results.append(found.join(judged.where("_good"), F.col("query_id") == F.col("_id"), "left_semi"))
        asked = judged.where("not _good").select("_id", "_v")
        n_asked = asked.count()
        if not n_asked:
            break
    if n_asked or not results:
        results.append(_best_of(_in_blocks(rows, asked, n, n_asked, dim, k), k))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return ranked(out, k, F.asc("score"))


def _judged(found: DataFrame, asked: DataFrame, hashes: Hashes, dim: int, k: int) -> DataFrame:
    """_id, _v, and whether the query found k rows and its cells reach as far as the last of them."""

    def reached(v: pa.Array, far: pa.Array) -> pa.Array:
        return pa.array(hashes.reached(matrix(v, dim), far.to_numpy(zero_copy_only=False)))

    last = found.groupBy("query_id").agg(F.count("*").alias("_got"), F.max("score").alias("_far"))
    chance = F.arrow_udf(reached, "double")("_v", F.coalesce("_far", F.lit(0.0)))
    judged = asked.join(last, F.col("_id") == F.col("query_id"), "left").withColumn("_chance", chance)
    good = (F.coalesce("_got", F.lit(0)) >= k) & (F.col("_chance") >= LEAST)
    return judged.select("_id", "_v", good.alias("_good"))


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of what its cells or blocks gave; a row found twice counts once."""
    once = found.dropDuplicates(["query_id", "_n"])
    order = Window.partitionBy("query_id").orderBy("score", "vec_id", "_n")
    return once.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op8_nearest_neighbours": op8_nearest_neighbours}
ORACLES: dict[str, str] = {}
