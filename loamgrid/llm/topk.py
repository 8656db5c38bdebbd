"""Exact top-k search by distributed histogram selection.

Every pass scores all candidates against all queries, block by block, and counts the scores into a histogram for each
query. The bin that holds the k-th value becomes the next pass's range, until bins are one score wide: that score is
the query's threshold. A last pass keeps what reaches it and breaks ties by the smaller id.

Blocks are matrices of bounded size. A candidate block meets every query block by an equi-join on a deal number, so
scores never become rows: a pass moves histograms only, and tasks add up histograms before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import written

BINS = 1024
CANDIDATES = 2048
QUERIES = 512
#: Histograms of so many query blocks are held in a task at once.
HELD = 8


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of up to so many vectors: dim, n, ids (int64), cells (float64, floor of 256 times the component), norm."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held[dim]])
            cells = np.concatenate([x[1] for x in held[dim]])
            held[dim] = [(ids[rows:], cells[rows:])] if len(ids) > rows else []
            ids, cells = ids[:rows], cells[:rows]
            norm = float(np.sqrt((cells**2).sum(axis=1)).max(initial=0.0))
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "cells": [cells.tobytes()], "norm": [norm]})

        for batch in batches:
            sizes = batch.column("cells").value_lengths().to_numpy()
            flat = np.floor(batch.column("cells").flatten().to_numpy(zero_copy_only=False) * 256.0)
            ids = batch.column("id").to_numpy()
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                cells = flat[(ends[at] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))
                held.setdefault(int(dim), []).append((ids[at], cells))
                while sum(len(x[0]) for x in held[int(dim)]) >= rows:
                    yield block(int(dim))
        for dim in held:
            if sum(len(x[0]) for x in held[dim]):
                yield block(dim)

    return vectors.mapInArrow(pack, "dim int, n int, ids binary, cells binary, norm double")


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows as int64, held at the limits of int64 where they go beyond."""
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    wide = np.vectorize(int, otypes=[object])
    exact = wide(q) @ wide(c).T
    return np.array([[min(max(int(v), -(2**63)), 2**63 - 1) for v in row] for row in exact], dtype=np.int64).reshape(len(q), len(c))


def scored(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores, mask of pairs of different ids) of a joined pair of blocks."""
    dim = row["dim"]
    qi, ci = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    q, c = (np.frombuffer(row[k], np.float64).reshape(len(i), dim) for k, i in (("q_cells", qi), ("cells", ci)))
    return qi, ci, scores(q, c), qi[:, None] != ci[None, :]


def count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}

    def out(qb: int, counts: np.ndarray) -> pa.RecordBatch:
        i, b = np.nonzero(counts)
        return pa.RecordBatch.from_pydict({"qb": np.full(len(i), qb, np.int64), "i": i.astype(np.int32), "bin": b.astype(np.int32), "n": counts[i, b]})

    for batch in batches:
        for row in batch.to_pylist():
            qi, _, s, other = scored(row)
            lo, width, span = (np.array(row[x], np.int64)[:, None] for x in ("lo", "width", "span"))
            at = s - lo
            ok = other & (at >= 0) & (at < span)
            at = np.where(ok, at // width, 0)
            flat = (np.arange(len(qi))[:, None] * BINS + at)[ok]
            counts = np.bincount(flat, minlength=len(qi) * BINS).reshape(len(qi), BINS)
            qb = row["qb"]
            if qb in held:
                held[qb] += counts
            else:
                if len(held) >= HELD:
                    first = next(iter(held))
                    yield out(first, held.pop(first))
                held[qb] = counts
    for qb, counts in held.items():
        yield out(qb, counts)


def keep_best(k: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qi, ci, s, other = scored(row)
                ok = other & (s >= np.array(row["lo"], np.int64)[:, None])
                i, j = np.nonzero(ok)
                order = np.lexsort((ci[j], -s[i, j], i)) if len(i) else np.zeros(0, int)
                i, j = i[order], j[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[rank < k], j[rank < k]
                yield pa.RecordBatch.from_pydict({"qb": np.full(len(i), row["qb"], np.int64), "i": i.astype(np.int32), "query_id": qi[i], "vec_id": ci[j], "score": s[i, j]})

    return keep


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k best candidates (all rows but those of the query's own id) of every query row, by integer inner product.

    Returns query_id, rank (from 1), vec_id and score, best first, ties to the smaller id. Rows with a null id, a null
    vector, or a vector holding null or non-finite components take no part, nor those with a component beyond 7e305,
    256 times which is no double. Rows that repeat a query's id are no candidates of it. Queries meet candidates of their own
    dimension. A repeated row is a candidate, and a query, of its own. Without candidates a query has no rows. Columns
    besides id and vector play no part. Scores outside the range of a long are held at its limits.
    """
    spark = vectors.sparkSession
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 7e305)
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("cells"), is_query.alias("asks"))
    base = base.where(F.col("id").isNotNull() & F.col("cells").isNotNull() & ~F.exists("cells", bad))
    blocks = written(packed(base.select("id", "cells"), CANDIDATES), "candidates")
    asking = written(packed(base.where("asks").select("id", "cells"), QUERIES).withColumn("qb", F.monotonically_increasing_id()), "queries")
    most = blocks.agg(F.max("norm")).first()[0] or 0.0
    deals = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.select("dim", "ids", "cells", F.pmod(F.xxhash64("ids"), F.lit(deals)).alias("deal"))
    q = asking.select("dim", "qb", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), "norm")

    bound = F.least(F.ceil(F.col("norm") * F.lit(most)) + 1, F.lit(2**61))
    state = q.select("qb", F.posexplode(F.array_repeat(F.lit(0), F.col("q_n"))).alias("i", "_"), (-bound).cast("bigint").alias("lo"), F.ceil((2.0 * bound + 1) / BINS).cast("bigint").alias("width"), (2 * bound + 1).cast("bigint").alias("span"), F.lit(k).cast("bigint").alias("need")).drop("_")
    top = asking.agg(F.max("norm")).first()[0] or 0.0
    widest = math.ceil((2.0 * min(math.ceil(top * most) + 1, 2**61) + 1) / BINS)

    def meeting(state: DataFrame) -> DataFrame:
        rows = state.groupBy("qb").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "width", "span"))).alias("s"))  # QUERIES at most
        full = q.join(rows, "qb").select("dim", "qb", "q_ids", "q_cells", F.col("s.lo").alias("lo"), F.col("s.width").alias("width"), F.col("s.span").alias("span"))
        spread = full.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(deals - 1).cast("bigint"))))
        return dealt.hint("merge").join(spread, ["dim", "deal"])

    while True:
        bins = meeting(state).mapInArrow(count_bins, "qb bigint, i int, bin int, n bigint").groupBy("qb", "i", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("qb", "i").orderBy(F.desc("bin"))  # BINS rows at most
        passed = bins.withColumn("through", F.sum("n").over(down)).join(state, ["qb", "i"])
        found = passed.where("through >= need and through - n < need")
        narrowed = found.select("qb", "i", (F.col("lo") + F.col("bin") * F.col("width")).alias("lo2"), (F.col("need") - F.col("through") + F.col("n")).alias("need2"))
        # Fewer candidates than asked for: the range stays at its lower end, which all of them reach.
        narrower = F.greatest(F.ceil(F.col("width") / BINS), F.lit(1)).cast("bigint")
        state = state.join(narrowed, ["qb", "i"], "left").select("qb", "i", F.coalesce("lo2", "lo").alias("lo"), narrower.alias("width"), F.col("width").alias("span"), F.coalesce("need2", "need").alias("need"))
        state = written(state, "state")
        if widest == 1:
            break
        widest = math.ceil(widest / BINS)

    best = meeting(state).mapInArrow(keep_best(k), "qb bigint, i int, query_id bigint, vec_id bigint, score bigint")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("qb", "i").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
