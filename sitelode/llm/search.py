"""Exact top-k inner products by block-at-a-time pruning.

Vectors are cut into blocks of consecutive ids. A block keeps its forward index (the vectors as one matrix) and the largest and
smallest value of each component. For a query, the sum over components of the larger of ``q * max`` and ``q * min`` bounds every
score in the block; blocks are scored in descending order of that bound until it falls below the query's k-th score.
Queries and blocks meet in a grid: groups of queries and groups of blocks of bounded size, each pair one task group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import durable

# Vectors in a block; blocks in a group; queries in a group.
BLOCK = 1024
BLOCK_GROUP = 32
QUERY_GROUP = 4096
SCALE = 1024.0
# Least scaled component that is out of range: products of smaller ones stay whole 64-bit numbers over 4096 components.
LARGEST = 1 << 25

# Below every score, and still negatable.
NO_SCORE = np.iinfo(np.int64).min + 1

BLOCK_SCHEMA = "part int, at int, n int, dims int, ids binary, vectors binary, high binary, low binary"
HIT_SCHEMA = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` with ``floor(1024 * x)`` of each component; vectors that are null, empty, or hold null or non-finite components,
    and rows without an id, take no part.

    A kept component of ``LARGEST / 1024`` or more either way is an error that names its row: inner products of such vectors could leave the range
    of whole numbers.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.size("embedding") > 0
    sound &= ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    out = F.concat(F.lit("vector out of range: "), F.col("vec_id").cast("string"))
    scaled = F.transform(x, lambda e: F.when(F.abs(e) < LARGEST / SCALE, F.floor(e * SCALE)).otherwise(F.raise_error(out).cast("long")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select("vec_id", scaled.alias("v"))


def of_one_dimension(ready: DataFrame) -> DataFrame:
    """``ready`` as a table, if all its vectors have the same number of components; otherwise an error with the numbers and an id of each."""
    written = durable(ready)
    sizes = written.groupBy(F.size("v").alias("n")).agg(F.min("vec_id").alias("id")).orderBy("n").limit(5).collect()
    if len(sizes) > 1:
        raise ValueError("vectors of different dimensions: " + ", ".join(f"{r['n']} (vec_id {r['id']})" for r in sizes))
    return written


def _cut(size: int):
    def cut(batches):
        at, held, rows = 0, [], 0

        def block(table):
            values = table.column("v").combine_chunks()
            values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
            flat = values.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
            return {"part": [0], "at": [at], "n": [len(table)], "dims": [flat.shape[1]],
                    "ids": [table.column("vec_id").to_numpy().astype(np.int64).tobytes()],
                    "vectors": [flat.astype(np.int64).tobytes()], "high": [flat.max(0).astype(np.int64).tobytes()],
                    "low": [flat.min(0).astype(np.int64).tobytes()]}

        schema = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()),
                            ("vectors", pa.binary()), ("high", pa.binary()), ("low", pa.binary())])
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= size:
                table = pa.Table.from_batches(held)
                made = block(table.slice(0, size)) | {"part": [task]}
                yield pa.RecordBatch.from_pydict(made, schema)
                rest = table.slice(size)
                held, rows, at = rest.to_batches(), rest.num_rows, at + 1
        if rows:
            yield pa.RecordBatch.from_pydict(block(pa.Table.from_batches(held)) | {"part": [task]}, schema)
    return cut


def _matrix(row, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(-1, dims)


def _exact(product_of: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles are exact, and much faster, while no sum can reach 2 ** 53."""
    top = float(np.abs(product_of).max(initial=0)) * float(np.abs(other).max(initial=0)) * product_of.shape[1]
    if top < 2.0 ** 53:
        return (product_of.astype(np.float64) @ other.astype(np.float64).T).astype(np.int64)
    return product_of @ other.T


def _score(k: int):
    def score(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        qs, bs = queries.to_pylist(), blocks.to_pylist()
        if not qs or not bs:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        dims = bs[0]["dims"]
        qid = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in qs])
        q = np.concatenate([np.frombuffer(r["vectors"], np.int64).reshape(-1, dims) for r in qs])
        high = np.stack([np.frombuffer(b["high"], np.int64) for b in bs])
        low = np.stack([np.frombuffer(b["low"], np.int64) for b in bs])
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bound = _exact(up, high) + _exact(down, low)
        order = np.argsort(-bound, axis=1, kind="stable")
        n = len(q)
        best = np.full((n, k), NO_SCORE)
        ids = np.full((n, k), np.iinfo(np.int64).max)
        live = np.arange(n)
        for step in range(len(bs)):
            at = order[live, step]
            # Equal bounds still matter: ties go to the smaller id.
            live = live[bound[live, at] >= best[live, k - 1]]
            if not len(live):
                break
            at = order[live, step]
            for b in np.unique(at):
                rows = live[at == b]
                bid, vectors = _matrix(bs[b], dims)
                s = _exact(q[rows], vectors)
                s[qid[rows][:, None] == bid[None, :]] = NO_SCORE
                every_s = np.concatenate([best[rows], s], 1)
                every_i = np.concatenate([ids[rows], np.broadcast_to(bid, s.shape)], 1)
                if every_s.shape[1] > 4 * k:  # all that reach the k-th score, then exact order among them
                    kth = np.partition(every_s, every_s.shape[1] - k, axis=1)[:, -k]
                    for i, row in enumerate(rows):
                        mine = np.nonzero(every_s[i] >= kth[i])[0]
                        mine = mine[np.lexsort((every_i[i, mine], -every_s[i, mine]))][:k]
                        best[row, :len(mine)], ids[row, :len(mine)] = every_s[i, mine], every_i[i, mine]
                else:
                    for i, row in enumerate(rows):
                        mine = np.lexsort((every_i[i], -every_s[i]))[:k]
                        best[row, :len(mine)], ids[row, :len(mine)] = every_s[i, mine], every_i[i, mine]
        real = best > NO_SCORE
        return pa.table({"query_id": np.repeat(qid, real.sum(1)), "vec_id": ids[real], "score": best[real]})
    return score


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose id is divisible by ``every``, its ``k`` highest inner products with
    vectors of other ids, or all if there are fewer; ties go to the smaller id.

    ``vectors``: ``vec_id, embedding``; vectors of different dimensions are an error. See :func:`quantized` for rows that take no part. Rows that repeat an id
    are separate candidates; the results of a query id that repeats are ranked together. Components
    are whole numbers, so scores are exact.
    """
    ready = of_one_dimension(quantized(vectors))
    spark = ready.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(rows: DataFrame, size: int) -> DataFrame:
        return rows.mapInArrow(_cut(size), BLOCK_SCHEMA)

    ranged = ready.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
    stored = durable(blocks(ranged, block))
    asked = durable(blocks(ready.filter(F.col("vec_id") % every == 0).repartitionByRange(parts, "vec_id"), block))

    n_blocks, n_asked = stored.count(), asked.count()
    b_groups, q_groups = max(1, -(-n_blocks // BLOCK_GROUP)), max(1, -(-n_asked * block // QUERY_GROUP))
    left = asked.withColumn("qg", F.pmod(F.xxhash64("part", "at"), F.lit(q_groups))).withColumn(
        "bg", F.explode(F.expr(f"sequence(0L, {b_groups - 1}L)")))
    right = stored.withColumn("bg", F.pmod(F.xxhash64("part", "at"), F.lit(b_groups))).withColumn(
        "qg", F.explode(F.expr(f"sequence(0L, {q_groups - 1}L)")))
    found = left.groupBy("qg", "bg").cogroup(right.groupBy("qg", "bg")).applyInArrow(_score(k), HIT_SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
