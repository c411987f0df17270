"""Exact top-k search: tiles of query blocks and candidate blocks, partial selection, tree merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block; a tile is one query block times one candidate block.
BLOCK = 4096
#: Tiles that the first level of the tree merges.
FAN_IN = 64


def _pack(batch: pa.Table) -> pa.Table:
    """One row for each vector length of a block: ids ascending and the quantised components."""
    out: dict[int, list[tuple[int, tuple]]] = {}
    for block, i, v in zip(batch.column("block").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
        if i is None or v is None or any(x is None or x - x != 0 for x in v):
            continue
        q = tuple(int(x) for x in np.floor(256 * np.asarray(v, np.float64)))
        out.setdefault(len(q), []).append((i, q))
    block = batch.column("block")[0].as_py()
    rows = []
    for dim, found in sorted(out.items()):
        found.sort()
        ids, data = [i for i, _ in found], [q for _, q in found]
        large = max((abs(x) for q in data for x in q), default=0)
        exact = large < 2**62
        body = np.array(data, np.int64 if exact else object).reshape(len(ids), dim)
        rows.append((block, dim, np.array(ids, np.int64).tobytes(), body.tobytes() if exact else repr(data).encode(), exact, str(large)))
    names = ["block", "dim", "ids", "data", "exact", "large"]
    return pa.table(dict(zip(names, map(list, zip(*rows, strict=True)) if rows else [[]] * 6, strict=True)), schema=pa.schema([("block", pa.int64()), ("dim", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("exact", pa.bool_()), ("large", pa.string())]))


_PACKED = "block long, dim long, ids binary, data binary, exact boolean, large string"


def _matrix(data: bytes, dim: int, exact: bool) -> np.ndarray:
    if exact:
        return np.frombuffer(data, np.int64).reshape(-1, dim)
    import ast

    return np.array(ast.literal_eval(data.decode()), object).reshape(-1, dim)


def _tile(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k best of each query in the tile; ties go to the smaller vec_id."""
    dim = row["dim"]
    qi, ci = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    q, c = _matrix(row["q_data"], dim, row["q_exact"]), _matrix(row["data"], dim, row["exact"])
    small = int(row["q_large"]) * int(row["large"]) * max(dim, 1) * len(ci) < 2**52
    if small:
        q, c = q.astype(np.float64), c.astype(np.float64)
    out: list[list[np.ndarray]] = [[], [], []]
    own, behind = np.searchsorted(ci, qi), np.searchsorted(ci, qi, "right")
    for at in range(0, len(qi), 512):
        if small:
            key = (q[at : at + 512] @ c.T) * len(ci) + (len(ci) - 1 - np.arange(len(ci)))
            lowest = -np.inf
        else:
            key = np.dot(q[at : at + 512].astype(object), c.T.astype(object)) * len(ci) + (len(ci) - 1 - np.arange(len(ci))).astype(object)
            lowest = -(2**400)
        for k_own in np.flatnonzero(behind[at : at + 512] > own[at : at + 512]):  # rows of the query's id
            key[k_own, own[at + k_own] : behind[at + k_own]] = lowest
        n = min(k, len(ci))
        best = np.argpartition(-key, n - 1, axis=1)[:, :n] if small else np.argsort(-key, axis=1)[:, :n]
        got = np.take_along_axis(key, best, axis=1)
        ok = (got != lowest).astype(bool)
        score = np.floor_divide(got[ok], len(ci))
        out[0].append(np.repeat(qi[at : at + 512], n).reshape(-1, n)[ok])
        out[1].append(ci[best[ok]])
        out[2].append(score.astype(np.int64) if small else np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in score], np.int64))
    return tuple(np.concatenate(x) for x in out)  # type: ignore[return-value]


def _blocks(vectors: DataFrame, n: int) -> DataFrame:
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n))
    return vectors.withColumn("block", block).groupBy("block").applyInArrow(_pack, _PACKED)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """The k highest integer inner products of each query with every other row.

    Components x become floor(256 * x). Rows with a null id, a null vector or a null or non-finite component
    take no part; vectors meet only vectors of their length; rows that share the query's id are its own, and
    rows that share another id are candidates each; the queries of one id share its k places. Scores beyond 64 bits saturate. Returns
    query_id, rank, vec_id, score; a query without candidates has no rows.

    Every query block is joined with every candidate block by a tile key, so that the work is blocks times
    blocks and no task holds more than one tile; each tile keeps k rows a query, merged in two levels.
    """
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(fine)
    queries = queries.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(fine)
    n_q, n_c = max(1, -(-queries.count() // block)), max(1, -(-vectors.count() // block))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = _blocks(queries, n_q).select(F.col("block").alias("q_block"), "dim", *[F.col(x).alias(f"q_{x}") for x in ("ids", "data", "exact", "large")]).withColumn("block", to(n_c))
    right = _blocks(vectors, n_c).withColumn("q_block", to(n_q))
    tiles = left.join(right.hint("merge"), ["q_block", "block", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                q, c, s = _tile(row, k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s), pa.array(np.full(len(q), row["block"] // FAN_IN))], ["query_id", "vec_id", "score", "part"])

    found = tiles.mapInArrow(run, "query_id long, vec_id long, score long, part long")
    best = [F.desc("score"), F.asc("vec_id")]
    for by in (["query_id", "part"], ["query_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
