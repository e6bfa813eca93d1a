"""Exact top-k search by inner product: exhaustive, term at a time, over quantised sparse vectors.

A term is a component's position, its postings the candidates that are non-zero there, with their weights. A task
walks its candidates in chunks. For each chunk and each block of queries it goes through the terms: every query row
that holds the term scatters the term's postings, times its own weight, into a dense array of scores (queries x chunk).
Once all terms are in, the best k of the chunk are selected by partition and merged with those held. The tasks' lists
are merged by rank per query. Every candidate meets every query; sums are exact integers (floating point
only where it can't round).

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
without an id; vectors of different lengths meet in the positions both have; a query finds no row of its own
id; of rows that repeat a query's id, the least vector asks; repeated candidates count each; ties go to the
smaller id; fewer than k candidates are all returned; large finite components are summed without bound, and only a
score among the best that a long can't hold raises OverflowError; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.plans.shared import bound_batches, fresh_path, materialise

#: Bytes of queries that are broadcast at once, as 8-byte numbers; one scan of the candidates answers them all.
QUERY_BYTES = 32 << 20
#: Candidates and queries of one dense array of scores.
CHUNK, QUERY_ROWS = 1024, 128
#: A list of postings is long from this part of the candidates on.
LONG = 4

#: The score of a query's own row, among numpy's and among Python's integers.
NONE, LOWEST = np.iinfo(np.int64).min, -(1 << 4000)

FOUND = "query_id long, vec_id long, score long"


def takes_part(vector: Column) -> Column:
    """Whether a vector has components, and none that is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def quantise(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64 where all fit, else Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not len(values) or np.abs(scaled).max() < 1 << 62:
        return scaled.astype(np.int64)
    # from 2**53 on a double is an integer itself
    return np.array([math.floor(x * scale) if abs(x) < 1 << 53 else int(x) * scale for x in values.tolist()], dtype=object)


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    """A ragged list column, quantised, as dense rows; short ones are filled up with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(column.value_lengths()))
    lengths = np.diff(ends, prepend=0)
    flat = quantise(flat, scale)
    out = np.zeros((len(column), int(lengths.max(initial=0))), dtype=flat.dtype)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    return out


def _exact_kind(queries: np.ndarray, chunk: np.ndarray):
    """The cheapest type in which no sum of products of these rows can round."""
    most = lambda x: [int(v) for v in np.abs(x).max(axis=0)] if len(x) else []
    bound = sum(a * b for a, b in zip(most(queries), most(chunk)))
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def accumulate(queries: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Scores (queries x chunk): per term, the query rows that hold it scatter its weighted postings.

    Where over 1/LONG of the rows and of the candidates hold a term, its postings are kept as a block with their
    zeros, which is added at once; shorter lists are scattered by position. Both give the same sums.
    """
    kind = _exact_kind(queries, chunk)
    scores, weighted = (np.zeros((len(queries), len(chunk)), dtype=kind) for _ in range(2))
    width = min(queries.shape[1], chunk.shape[1])
    met = np.array([t for t in range(width) if queries[:, t].any() and chunk[:, t].any()], dtype=int)  # others may not fit kind
    holders, lists = (np.ascontiguousarray(x[:, met].T, dtype=kind) for x in (queries, chunk))
    for asked, weights in zip(holders, lists, strict=True):
        rows, postings = np.flatnonzero(asked), np.flatnonzero(weights)
        if LONG * len(rows) > len(asked) and LONG * len(postings) > len(weights):
            np.multiply(asked[:, None], weights, out=weighted)
            scores += weighted
        else:
            scores[rows[:, None], postings] += np.multiply.outer(asked[rows], weights[postings])
    return scores if kind is object else scores.astype(np.int64, copy=False)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then smaller id: all above the k-th score, then its ties by id."""
    if scores.dtype == object:
        part = np.array([sorted(range(scores.shape[1]), key=lambda i, r=r: (-scores[r, i], ids[r, i]))[:k] for r in range(len(scores))])
        return np.take_along_axis(scores, part, 1), np.take_along_axis(ids, part, 1)
    if scores.shape[1] > k:
        part = np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]
        kth = np.take_along_axis(scores, part, 1).min(axis=1)
        tied = (scores >= kth[:, None]).sum(axis=1) > k
        for r in np.flatnonzero(tied):
            at = np.flatnonzero(scores[r] >= kth[r])
            part[r] = at[np.lexsort((ids[r, at], -scores[r, at]))[:k]]
        scores, ids = np.take_along_axis(scores, part, 1), np.take_along_axis(ids, part, 1)
    return scores, ids


def _wide(scores: np.ndarray) -> np.ndarray:
    """Python's integers, for scores beyond 64 bits."""
    out = scores.astype(object)
    out[out == NONE] = LOWEST
    return out


def _search(block, k: int, scale: int):
    """The k best of a task's candidates for each broadcast query, `QUERY_ROWS` queries and CHUNK candidates at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = block.value
        held = [(np.zeros((0, 0), dtype=np.int64),) * 2] * len(range(0, len(own), QUERY_ROWS))
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids, chunk = part.column(0).to_numpy(), _matrix(part.column(1), scale)
                order = np.argsort(ids, kind="stable")
                for i, low in enumerate(range(0, len(own), QUERY_ROWS)):
                    asking = own[low : low + QUERY_ROWS]
                    scores = accumulate(queries[low : low + QUERY_ROWS], chunk)
                    mine = np.zeros(scores.shape, dtype=bool)
                    first, last = (np.searchsorted(ids[order], asking, side) for side in ("left", "right"))
                    for r in np.flatnonzero(last > first):
                        mine[r, order[first[r] : last[r]]] = True
                    scores[mine] = LOWEST if scores.dtype == object else NONE
                    best, found = _best(scores, np.broadcast_to(ids, scores.shape), k)
                    if held[i][0].size:
                        if object in (best.dtype, held[i][0].dtype):
                            best, held[i] = _wide(best), (_wide(held[i][0]), held[i][1])
                        best, found = np.concatenate([held[i][0], best], axis=1), np.concatenate([held[i][1], found], axis=1)
                        best, found = _best(best, found, k)
                    held[i] = best, found
        for i, low in enumerate(range(0, len(own), QUERY_ROWS)):
            best, found = held[i]
            valid = (best != (LOWEST if best.dtype == object else NONE)).astype(bool)
            if not valid.any():
                continue
            rows = np.repeat(own[low : low + QUERY_ROWS], valid.sum(axis=1))
            scores = pa.array([int(v) for v in best[valid]] if best.dtype == object else best[valid], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found[valid], pa.int64()), scores], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding", query_block: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each row for which is_query holds.

    Queries are broadcast in blocks of QUERY_BYTES (65,536 queries of 64 components; `query_block` says another
    number), each in one job over all candidates; more than one block's results are kept in the shared folder.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    values = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    sparse = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), values.alias("terms"), is_query.alias("asks"))
    sparse = sparse.filter(F.col("vec_id").isNotNull() & takes_part(F.col("terms")))
    asking = sparse.filter("asks").groupBy("vec_id").agg(F.min("terms").alias("terms"))
    count, width = asking.agg(F.count(F.lit(1)), F.max(F.size("terms"))).first()
    per_block = query_block or max(1, QUERY_BYTES // (8 * (width or 1)))
    blocks = 1 if count <= per_block else -(-2 * count // per_block)  # hashed, so half full on the mean
    asking = asking.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    if blocks > 1:
        asking = materialise(asking, "queries")
    path = fresh_path(spark, "found")
    for b in range(blocks):
        table = asking.filter(F.col("block") == b).select("vec_id", "terms").orderBy("vec_id").toArrow()
        own = table.column(0).to_numpy()
        queries = _matrix(table.column(1).combine_chunks(), scale) if len(own) else np.zeros((0, 0), dtype=np.int64)
        shared = spark.sparkContext.broadcast((own, queries))
        found = sparse.select("vec_id", "terms").mapInArrow(_search(shared, k, scale), FOUND)
        if blocks == 1:
            break
        _ranked(found, k).write.mode("append").parquet(path)
        shared.unpersist()
    else:
        return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
