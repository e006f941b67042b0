"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Components become whole numbers (the impacts).  Vectors are packed into index blocks; a block's postings are grouped into
segments by the size of their impact, and a query takes the segments from the largest impact down, adding its products to
its candidates' scores.  What a candidate's remaining postings can still add is at most ``|q| * |rest of the candidate|``
(Cauchy-Schwarz, from norms kept in the index), so after each level every candidate has a lower and an upper bound.  A
query stops only when few candidates can still be among its k best, which proves the others out; those few are rescored
exactly.  A query that never gets that far runs out of segments and its scores are exact anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 4
BLOCK = 4096
QUERIES = 2048


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or has a null or non-finite component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")))


_PACKED = "tag bigint, dim int, ids binary, keys binary, impacts binary"
_PACKED_ARROW = pa.schema([("tag", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("impacts", pa.binary())])
_FOUND = "query_id bigint, key bigint, vec_id bigint, score bigint"
_FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _pack(size: int):
    """Rows (id, key, q) of a partition into blocks of up to ``size`` vectors of one dimension; ``tag`` tells blocks apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
        held: dict[int, tuple[list[int], list[int], list[np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, keys, rows = held.pop(dim)
            made += 1
            flat = np.concatenate(rows) if dim else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(keys, np.int64).tobytes()], pa.binary()), pa.array([flat.astype(np.int64).tobytes()], pa.binary())], schema=_PACKED_ARROW)

        for b in batches:
            q = b.column(2)
            flat, off = q.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(q.value_lengths().to_numpy(zero_copy_only=False))))
            for i, (vec, key) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                row = flat[off[i] : off[i + 1]]
                ids, keys, rows = held.setdefault(len(row), ([], [], []))
                ids.append(vec)
                keys.append(key)
                rows.append(row)
                if len(ids) == size:
                    yield flush(len(row))
        for dim in list(held):
            yield flush(dim)

    return run


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score) of each query's k best of the block, ties to the smaller id."""
    size = np.abs(c)
    top = int(size.max()) if c.size else 0
    most = float(top) * float(np.abs(q).max() if q.size else 0) * max(1, c.shape[1])
    kind = np.float32 if most < 1 << 22 else np.float64
    exact = most < float(1 << 51)
    level = np.minimum(LEVELS - 1, np.floor(np.log2(max(top, 1) / np.maximum(size, 1))).astype(np.int64)) if c.size else size
    norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    order = np.argsort(c_ids, kind="stable")
    lo, hi = np.searchsorted(c_ids[order], q_ids, "left"), np.searchsorted(c_ids[order], q_ids, "right")
    own_q = np.repeat(np.arange(len(q_ids)), hi - lo)
    own_c = order[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])] if len(own_q) else np.empty(0, np.int64)
    score = np.zeros((len(q), len(c)), kind)
    score[own_q, own_c] = -np.inf
    active, out, rest = np.arange(len(q)), [], c.astype(np.float64)
    qf = q.astype(kind)
    for n in range(LEVELS):
        segment = np.where(level == n, c, 0)
        rest = rest - segment
        left = np.sqrt((rest**2).sum(1))
        score += qf[active] @ segment.astype(kind).T
        slack = np.outer(norms[active], left).astype(kind)
        slack *= kind(1.0001)
        slack += kind(0.5 if exact else most * 1e-12)
        low = score - slack
        if low.shape[1] > k:
            bar = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        else:
            bar = np.full(len(low), -np.inf, kind)
        low = score + slack
        possible = (low >= bar[:, None]) & np.isfinite(low)
        count = possible.sum(1)
        stop = (count <= max(64, 8 * k)) | (n == LEVELS - 1)
        for a in np.flatnonzero(stop):
            who = np.flatnonzero(possible[a])
            if exact:
                full = c[who] @ q[active[a]]
            else:
                full = np.array([sum(int(x) * int(y) for x, y in zip(c[w], q[active[a]], strict=True)) for w in who], object)
                full = np.clip(full, -(1 << 63), (1 << 63) - 1).astype(np.int64) if len(who) else np.empty(0, np.int64)
            best = np.lexsort((c_ids[who], -full))[:k]
            out.append((np.full(len(best), active[a]), who[best], full[best]))
        score, active = score[~stop], active[~stop]
        if not len(active):
            break
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, qi, qk, qv, ci, cv in zip(*(b.column(x).to_pylist() for x in range(6)), strict=True):
                q_ids, c_ids = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                q, c = np.frombuffer(qv, np.int64).reshape(len(q_ids), dim), np.frombuffer(cv, np.int64).reshape(len(c_ids), dim)
                a, w, s = search_block(q_ids, q, c_ids, c, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(np.frombuffer(qk, np.int64)[a]), pa.array(c_ids[w]), pa.array(s.astype(np.int64))], schema=_FOUND_ARROW)

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", groups: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products over all rows with another id.

    Queries are the rows where ``queries`` holds.  Ties go to the smaller id.  Rows whose id is null, whose vector is null
    or holds a null or non-finite component take no part; vectors of another dimension than the query's are no candidates.
    A query with fewer than ``k`` candidates gets all, with none no row.  A repeated id is never its own candidate;
    equal queries are one, and different vectors of one id are queries of their own.

    Index blocks stay as they are packed; blocks of queries meet them by an equi-join on (block of queries, group), so
    neither side is broadcast whole or collected, and no task holds more than a block of each.
    """
    ok = vectors.select(F.col(id_col).cast("bigint").alias("id"), quantised(F.col(vector_col), scale).alias("q"), F.coalesce(queries, F.lit(False)).alias("_is_query")).filter("id is not null and q is not null")
    ok = ok.withColumn("key", F.xxhash64("id", "q"))
    asked = ok.filter("_is_query").select("id", "key", "q").dropDuplicates(["id", "q"])
    n = asked.count()
    blocks = max(1, -(-n // QUERIES))
    q = asked.repartition(blocks).mapInArrow(_pack(QUERIES), _PACKED).select("dim", F.col("tag").alias("qb"), F.col("ids").alias("q_ids"), F.col("keys").alias("q_keys"), F.col("impacts").alias("q_impacts"))
    q = q.withColumn("qpart", F.pmod(F.shiftright("qb", 32), F.lit(blocks).cast("bigint"))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    c = ok.select("id", "key", "q").mapInArrow(_pack(BLOCK), _PACKED).select("dim", F.col("tag"), F.col("ids").alias("c_ids"), F.col("impacts").alias("c_impacts"))
    c = c.withColumn("g", F.pmod(F.xxhash64("tag"), F.lit(groups).cast("bigint")).cast("int")).withColumn("qpart", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    met = c.join(q, ["dim", "qpart", "g"]).select("dim", "q_ids", "q_keys", "q_impacts", "c_ids", "c_impacts")
    found = met.mapInArrow(_search(k), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
