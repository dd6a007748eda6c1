"""Exact top-k inner products by columnar branch-and-bound over blocks of dimensions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise

#: Vectors of a candidate block, queries of a query block, dimensions of a step.
CANDIDATES, QUERIES, DIMS = 16_384, 512, 16
_GRID = 1024


def _grid(vectors: DataFrame) -> DataFrame:
    """``(id, d, v)``: each usable vector as integers floor(1024 * x); others are left out.

    Left out are null vectors, those with null or non-finite components, and rows without vec_id.
    A finite component whose integer does not fit a long is an error.
    """
    too_large = F.raise_error(F.lit("a component times 1024 does not fit a long")).cast("long")
    v = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) >= 2.0 ** 53, too_large).otherwise(F.floor(x.cast("double") * _GRID).cast("long")))
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("id"), F.size("embedding").alias("d"), v.alias("v"))


def _blocked(rows: DataFrame, column: str, size: int) -> DataFrame:
    """Rows dealt to blocks of about ``size`` rows of equal dimension, numbered in ``column``."""
    count = rows.count()
    blocks = max(1, -(-count // size))
    return rows.withColumn(column, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))


def best_in_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int, dims: int = DIMS):
    """The ``k`` best candidates of each query as (query row, candidate row, score).

    ``columns`` holds one row for each dimension. Dimensions are added in blocks, those of
    the largest mass first. After each block the k-th best lower bound (score so far minus the
    product of the remaining norms) is compared with each candidate's upper bound (plus that
    product), and candidates that cannot reach it are dropped.
    """
    order = np.argsort(-(queries.astype(float) ** 2).sum(0), kind="stable")
    whole = queries[:, order], columns[order]
    queries, columns = (x.astype(np.float64) for x in whole)
    d = len(columns)
    edges = [*range(0, d, dims), d]
    tail_c = [np.sqrt((columns[e:] ** 2).sum(0)) for e in edges]
    tail_q = [np.sqrt((queries[:, e:] ** 2).sum(1)) for e in edges]
    exact = float((queries ** 2).sum(1).max(initial=0)) * float((columns ** 2).sum(0).max(initial=0)) < 2.0 ** 104
    if not exact:  # products beyond doubles: whole numbers throughout
        queries, columns = (x.astype(object) for x in whole)
    first = queries[:, :edges[1]] @ columns[:edges[1]] if d else np.zeros((len(queries), len(ids)))
    out_q, out_c, out_s = [], [], []
    for q in range(len(queries)):
        alive = np.flatnonzero(ids != query_ids[q])
        score = first[q][alive]
        for step in range(1, len(edges)):
            if step > 1:
                a, b = edges[step - 1], edges[step]
                score = score + queries[q, a:b] @ columns[a:b, alive]
            if len(alive) > k and step < len(edges) - 1:
                plain = score.astype(np.float64)
                slack = tail_q[step][q] * tail_c[step][alive] * (1 + 1e-9) + 1e-6 + np.abs(plain) * 1e-12
                floor = np.partition(plain - slack, len(alive) - k)[len(alive) - k]
                keep = np.flatnonzero(plain + slack >= floor)
                alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score.astype(np.float64)))[:k] if exact else np.array(sorted(range(len(alive)), key=lambda i: (-score[i], ids[alive[i]]))[:k], int)
        out_q += [q] * len(best)
        out_c += alive[best].tolist()
        out_s += [int(x) for x in score[best]]
    return out_q, out_c, out_s


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest integer inner products of each query.

    Queries are the rows whose vec_id ``every`` divides; candidates all rows with another vec_id,
    of the same dimension. Components count as floor(1024 * x). Ties go to the smaller vec_id;
    fewer than ``k`` candidates are all returned. Rows that repeat a vec_id with the same vector count
    once; with other vectors each is a candidate, and of several queries the least vector is asked.
    Null, empty-valued or non-finite vectors take no part. A component or a score beyond a long is an error. More columns are ignored.

    Every block of candidates meets every block of queries in a task of its own, of fixed size;
    each task returns ``k`` rows a query, which are combined at the end.
    """
    grid = materialise(_grid(vectors).dropDuplicates(["id", "d", "v"]), "grid")
    asked = grid.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("d", "v")).alias("x")).select("id", "x.d", "x.v")
    asked = _blocked(materialise(asked, "queries"), "qb", queries)
    held = _blocked(grid, "cb", candidates)
    c_blocks, q_blocks = max(1, -(-grid.count() // candidates)), max(1, -(-asked.count() // queries))
    both = [F.sequence(F.lit(0), F.lit(n - 1)) for n in (q_blocks, c_blocks)]
    left = held.withColumn("qb", F.explode(both[0])).select("d", "cb", "qb", "id", "v")
    right = asked.withColumn("cb", F.explode(both[1])).select("d", "cb", "qb", "id", "v")

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(table["id"], np.int64)
        flat = table["v"].combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([x.flatten() for x in flat.chunks])
        return ids, np.asarray(flat, np.int64).reshape(len(ids), -1)

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        if not (c.num_rows and q.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        (ids, rows), (query_ids, asked_rows) = matrix(c), matrix(q)
        at_q, at_c, score = best_in_block(query_ids, asked_rows, ids, np.ascontiguousarray(rows.T), k)
        return pa.table({"query_id": query_ids[at_q], "vec_id": ids[at_c], "score": pa.array(score, pa.int64())})

    met = (left.groupBy("d", "cb", "qb").cogroup(right.groupBy("d", "cb", "qb"))
           .applyInArrow(run, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
