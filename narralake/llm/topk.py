"""Operator 5, exact top-k by inner product over integer vectors, longest vectors first.

Rows are dealt by descending length.  All vectors are rotated into the singular
directions of the row matrix, so the first coordinates carry most of an inner
product; after each step of coordinates the rest is at most the product of the
two remaining lengths (Cauchy-Schwarz), and pairs that cannot reach the k-th
best score so far are dropped.  Whole blocks are dropped by their longest
vector.  What survives is scored exactly in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.llm.common import keep, table
from narralake.llm.vectors import BLOCK, EVERY, GROUP, best_pairs, matrix, meet, n_blocks, ranked, usable

K = 10
SCALE = 1024
STEPS = (0.25, 0.5, 0.75)
_SCHEMA = "query_id long, vec_id long, score long"


def gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of the outer products of all vectors, one dim x dim matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch.column(0), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.arange(dim * dim), "v": total.ravel()})

    sums = vectors.select("_v").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v"))
    out = np.zeros(dim * dim)
    for i, v in sums.collect():
        out[i] = v
    return out.reshape(dim, dim)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the row matrix, strongest first."""
    _, directions = np.linalg.eigh(gram(vectors, dim))
    return np.ascontiguousarray(directions[:, ::-1])


def search(
    q: np.ndarray, q_ids: np.ndarray, bar: np.ndarray, x: np.ndarray, x_ids: np.ndarray, turn: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query position, row position, score) of each query in one block.

    `bar` is a score that the k-th best of each query is known to reach.
    """
    dim = x.shape[1]
    by_length = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")
    x, x_ids = x[by_length], x_ids[by_length]
    cuts = sorted({int(dim * s) for s in STEPS} - {0} | {dim})
    qr, xr = q @ turn, x @ turn
    q_rest = [np.linalg.norm(qr[:, c:], axis=1) for c in [0, *cuts]]
    x_rest = [np.linalg.norm(xr[:, c:], axis=1) for c in [0, *cuts]]
    slack = 1e-9 * dim * (q_rest[0][:, None] * x_rest[0].max(initial=0.0)) + 1e-6
    bar = bar.astype(np.float64).copy()
    kept_q, kept_x, kept_s = (np.zeros(0, np.int64) for _ in range(3))
    for qa in range(0, len(q), 512):
        qs = slice(qa, qa + 512)
        mine_q, mine_x, mine_s = (np.zeros(0, np.int64) for _ in range(3))
        for xa in range(0, len(x), 1024):
            xs = slice(xa, xa + 1024)
            # Rows come longest first: what this chunk cannot reach, none behind it can.
            hope = q_rest[0][qs] * x_rest[0][xa] + slack[qs, 0] >= bar[qs]
            if not hope.any():
                break
            at_q = np.flatnonzero(hope) + qa
            partial = np.zeros((len(at_q), x[xs].shape[0]))
            low = 0
            for i, cut in enumerate(cuts, 1):
                partial += qr[at_q, low:cut] @ xr[xs, low:cut].T
                low = cut
                alive = partial + q_rest[i][at_q, None] * x_rest[i][None, xs] + slack[at_q] >= bar[at_q, None]
                stay = alive.any(axis=1)
                if not stay.all():
                    at_q, partial, alive = at_q[stay], partial[stay], alive[stay]
                if not len(at_q):
                    break
            if not len(at_q):
                continue
            pq, px = np.nonzero(alive & (q_ids[at_q][:, None] != x_ids[None, xs]))
            pq, px = at_q[pq], px + xa
            score = np.concatenate(
                [np.zeros(0, np.int64)]
                + [
                    np.einsum("ij,ij->i", q[pq[a : a + 65536]].astype(np.int64), x[px[a : a + 65536]].astype(np.int64))
                    for a in range(0, len(pq), 65536)
                ]
            )
            mine_q, mine_x, mine_s = (
                np.concatenate(p) for p in ((mine_q, pq), (mine_x, px), (mine_s, score))
            )
            top = best_pairs(mine_q, -mine_s, x_ids[mine_x], k)
            mine_q, mine_x, mine_s = mine_q[top], mine_x[top], mine_s[top]
            found, n = np.unique(mine_q, return_counts=True)
            last = np.cumsum(n) - 1
            full = n == k
            bar[found[full]] = np.maximum(bar[found[full]], mine_s[last[full]])
        kept_q, kept_x, kept_s = (
            np.concatenate(p) for p in ((kept_q, mine_q), (kept_x, mine_x), (kept_s, mine_s))
        )
    return kept_q, by_length[kept_x], kept_s


def inner_product_top_k(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest integer inner products.

    Components x become floor(scale * x).  Null vectors, vectors with a null or
    non-finite component and rows with a null id take no part; a shorter vector
    counts as ending in zeros.  Rows with the query's own id are no candidates;
    a repeated query id is asked once, a repeated row is found as often as it
    occurs.  Ties go to the smaller id.  Only the id and the vector are read,
    so other columns cannot clash; empty tables give an empty result.
    Components are expected to keep sums of products under 2^53.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
        return df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
            F.col(key).cast("long").alias("_id"), v.alias("_v")
        )

    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    rows = whole(vectors).withColumn("_length", length)
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("_v")), F.lit(0))).first()
    dim = max(1, dim)
    blocks = n_blocks(n, BLOCK)
    dealt = rows.repartitionByRange(blocks, F.desc("_length"), "_id")
    dealt = keep(dealt.withColumn("_block", F.spark_partition_id()), "rows")
    blocks = 1 + (dealt.agg(F.max("_block")).first()[0] or 0)
    asked = keep(whole(queries).dropDuplicates(["_id"]), "queries")
    groups = n_blocks(asked.count(), GROUP)
    asked = asked.withColumn("_group", F.pmod(F.hash("_id"), F.lit(groups)))
    turn = vectors.sparkSession.sparkContext.broadcast(rotation(dealt, dim))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, x_ids = left["_id"].to_numpy(), right["_id"].to_numpy()
        if not len(q_ids) or not len(x_ids):
            found = tuple(np.zeros(0, np.int64) for _ in range(3))
        else:
            found = search(
                matrix(left["_v"], dim), q_ids, left["_bar"].to_numpy(), matrix(right["_v"], dim), x_ids, turn.value, k
            )
        at_q, at_x, score = found
        return pa.table({"query_id": q_ids[at_q], "vec_id": x_ids[at_x], "score": score})

    # The block of the longest vectors sets the bar for all others.
    lowest = F.lit(float("-inf"))
    head = keep(
        meet(asked.withColumn("_bar", lowest), dealt.where("_block = 0"), 1, groups, kernel, _SCHEMA), "head"
    )
    bars = head.groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("score").cast("double")).alias("_known")
    )
    raised = asked.join(bars, asked["_id"] == bars["query_id"], "left").select(
        "_id", "_v", "_group", F.coalesce("_known", lowest).alias("_bar")
    )
    found = head
    if blocks > 1:
        found = head.unionByName(
            meet(raised, dealt.where("_block > 0"), blocks, groups, kernel, _SCHEMA, first_block=1)
        )
    return ranked(found, k, F.desc("score"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return inner_product_top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op5_exact_top_k": op5_exact_top_k}
ORACLES = {"op5_exact_top_k": OP5_SQL}
