"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Vectors are centred, rotated by iterative quantisation (learned on a bounded sample) and cut to their signs. A code is
split into substrings, each indexed by its value. Two codes within a Hamming radius have some substring within
radius / substrings, so probing each substring's index that far around finds every code within the radius; those
are reranked by cosines of the original vectors. Codes are several times as long as vectors have dimensions: the longer
the code, the smaller the share of rows within a radius that holds the same neighbours. The index lies in shards of bounded size: a query goes to each shard
once, its nearest there come back, and the nearest of these remain.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut

SUBSTRING = 8
SHARD_ROWS = 16_384
BLOCK_QUERIES = 8192


class Index(NamedTuple):
    rows: DataFrame  # shard, row (a number of its own), vec_id, embedding, code
    radius: int
    shards: int
    mean: np.ndarray
    projection: np.ndarray


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles of the rows that take part: no null, zero or odd vectors, no null id."""
    doubles = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return doubles.where(~odd & F.exists("embedding", lambda x: x != 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two near their largest component: exact, and without overflow later."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors have equal cosines."""
    return (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


def learn(sample: np.ndarray, bits: int, rounds: int = 25, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits): principal axes under rotations learned by iterative quantisation, as many of them side by side as bits ask for."""
    mean = sample.mean(0)
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=False)
    flat = (sample - mean) @ axes.T
    rng, parts, dims = np.random.default_rng(seed), [], axes.shape[0]
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(flat.T @ np.where(flat @ turn > 0, 1.0, -1.0))
            turn = u @ v
        parts.append(axes.T @ turn)
    return mean, np.concatenate(parts, 1)[:, :bits]


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return np.packbits((x - mean) @ projection > 0, axis=1)


def learned_radius(sample: np.ndarray, packed: np.ndarray, recall: float, k: int, n: int, probes: int = 256) -> int:
    """The least Hamming radius that holds the given share of the sample's true k nearest pairs, of the similarity that
    the k nearest of n rows have: the sample's pairs stand in for all, its k nearest lie further than those of more rows."""
    near = []
    for lo in range(0, min(probes, len(sample)), 32):
        cos = sample[lo : lo + 32] @ sample.T
        cos[np.arange(len(cos)), lo + np.arange(len(cos))] = -2
        top = np.argpartition(-cos, min(k, cos.shape[1] - 1), axis=1)[:, :k]
        near.append(np.bitwise_count(packed[lo : lo + len(cos), None] ^ packed[top]).sum(2))
    return int(np.quantile(np.concatenate(near), recall, method="higher"))


def build(vectors: DataFrame, bits: int = 256, sample: int = 8192, recall: float = 0.985, k: int = 5, seed: int = 11) -> Index:
    """Indexes every usable vector. Rotation and radius are fitted on the sample vectors that have the least hash.

    Vectors shorter than the sample's usual length stand as if zeros followed; longer ones are an error. Repeated rows
    are rows of their own. Shards come from a hash of id and vector and number one for each SHARD_ROWS vectors.
    """
    spark, rows = vectors.sparkSession, usable(vectors)
    total, key = rows.count(), F.xxhash64("vec_id", "embedding", F.lit(seed))
    drawn = rows.where(F.pmod(key, F.lit(1 << 40)) <= (1 << 40) * min(1.0, 2 * sample / max(total, 1)))  # some 2 x sample rows at any size
    drawn = drawn.orderBy(key, "vec_id").limit(sample).toPandas()
    shards = max(1, -(-total // SHARD_ROWS))
    if not total:
        return Index(rows.selectExpr("0 as shard", "0L as row", "vec_id", "embedding", "cast(null as binary) as code"), 0, 1, np.zeros(1), np.zeros((1, bits)))
    dims = int(drawn.embedding.map(len).max())
    x = unit(stack(drawn.embedding.tolist(), dims))
    mean, projection = learn(x, bits)
    packed = codes(x, mean, projection)
    radius = learned_radius(x, packed, recall, k, total) if len(x) > k else bits
    held = spark.sparkContext.broadcast((mean, projection, dims))

    names = ["shard", "row", "vec_id", "embedding"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projection, dims = held.value
        for b in batches:
            if b.num_rows:
                code = codes(unit(stack(b.column("embedding").to_pylist(), dims)), mean, projection)
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array([c.tobytes() for c in code], pa.binary())], [*names, "code"])

    sharded = rows.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int").alias("shard"), F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")
    return Index(cut(sharded.mapInArrow(encode, "shard int, row long, vec_id long, embedding array<double>, code binary"), "mih-index"), radius, shards, mean, projection)


def stack(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        if len(r) > dims:
            raise ValueError(f"a vector has {len(r)} components; the index has {dims}")
        out[i, : len(r)] = r
    return out


def probe_order(width: int = SUBSTRING) -> np.ndarray:
    """For each distance the masks of a substring at that distance, by distance."""
    masks = np.arange(1 << width, dtype=np.uint16)
    return masks[np.argsort(np.bitwise_count(masks), kind="stable")].astype(np.uint8)


def reaches(radius: int, tables: int) -> list[int]:
    """How far each table must be probed: if all substrings differed by more, the codes would by more than the radius.

    With radius = tables * q + r that is q for the first r + 1 tables and q - 1 (none for q = 0) for the others.
    """
    q, r = divmod(radius, tables)
    return [q if j <= r else q - 1 for j in range(tables)]


def touched(tables: list[tuple[np.ndarray, np.ndarray]], code: np.ndarray, rows: int, radius: int) -> np.ndarray:
    """Which rows the index names: those with some substring within its table's reach. All rows within radius are among them."""
    found = np.zeros(rows, bool)
    for (order, first), value, reach in zip(tables, code, reaches(radius, len(tables)), strict=True):
        masks = PROBES[: np.searchsorted(np.bitwise_count(PROBES), reach, side="right")] if reach >= 0 else PROBES[:0]
        at = (masks ^ value).astype(np.int64)
        lo, n = first[at], first[at + 1] - first[at]
        keep = n > 0
        lo, n = lo[keep], n[keep]
        if len(n):
            found[order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        if found.all():  # no other table can add a row
            break
    return found


def indexed(packed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each substring the rows by its value, and where each value's rows begin."""
    tables = []
    for j in range(packed.shape[1]):
        order = np.argsort(packed[:, j], kind="stable")
        tables.append((order, np.searchsorted(packed[order, j], np.arange(257))))
    return tables


def probe(tables: list[tuple[np.ndarray, np.ndarray]], code: np.ndarray, packed: np.ndarray, radius: int) -> np.ndarray:
    """Rows whose code lies within radius of code, in order."""
    rows = np.flatnonzero(touched(tables, code, len(packed), radius))
    if not packed.shape[1] % 8:
        packed, code = packed.view(np.uint64), code.view(np.uint64)
    return rows[np.bitwise_count((packed if len(rows) == len(packed) else packed[rows]) ^ code).sum(1, dtype=np.int64) <= radius]


PROBES = probe_order()


def search(index: Index, queries: DataFrame | str, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each query, by cosine in double precision.

    Queries are the index's rows that meet a condition, or rows of a DataFrame (vec_id, embedding). A query's own row of
    the index is no candidate, any other is, with the same id or vector too; rows of a DataFrame have none. In a
    shard the radius grows until k candidates or all rows are found, so a query gets k rows whenever there are k. Ties go
    to the smaller vec_id. Queries are taken in blocks and each meets each shard, whose size is bounded; only k rows a
    query and shard come back. Odd queries give no rows; rows that repeat an id are queries of their own.
    """
    if isinstance(queries, str):
        asked = index.rows.where(queries).select("row", "vec_id", "embedding")
    else:
        asked = cut(usable(queries).select((-1 - F.monotonically_increasing_id()).alias("row"), "vec_id", "embedding"), "mih-queries")
    spark, radius, mean, projection = index.rows.sparkSession, index.radius, index.mean, index.projection
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wide = asked.select("row", "vec_id", "embedding", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", each(index.shards))
    coded = index.rows.select("shard", "row", "vec_id", "embedding", "code").withColumn("block", each(blocks))
    held = spark.sparkContext.broadcast((mean, projection))

    def nearest(left, right):
        import pandas as pd

        empty = pd.DataFrame({"asked": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return empty
        mean, projection = held.value
        ids, numbers = left.vec_id.to_numpy(), left.row.to_numpy()
        x, q = scaled(stack(left.embedding.tolist(), len(mean))), scaled(stack(right.embedding.tolist(), len(mean)))
        length = np.sqrt((x * x).sum(1))
        packed = np.frombuffer(b"".join(left.code), np.uint8).reshape(len(left), -1)
        tables, out = indexed(packed), []
        for number, key, vector, code in zip(right.row.tolist(), right.vec_id.tolist(), q, codes(unit(q), mean, projection), strict=True):
            reach = radius
            rows = probe(tables, code, packed, reach)
            while (numbers[rows] != number).sum() < k and reach < packed.shape[1] * 8:
                reach = min(reach + 4, packed.shape[1] * 8)
                rows = probe(tables, code, packed, reach)
            rows = rows[numbers[rows] != number]
            if len(rows) > k:
                rough = x[rows] @ vector / length[rows]
                rows = rows[rough >= np.partition(rough, len(rows) - k)[len(rows) - k] - 1e-9 * np.abs(rough).max()]
            exact = cosines(x[rows], vector)
            for i in np.lexsort((ids[rows], -exact))[:k]:
                out.append((number, key, int(ids[rows[i]]), float(exact[i])))
        return pd.DataFrame(out, columns=["asked", "query_id", "vec_id", "score"]) if out else empty

    found = coded.groupBy("shard", "block").cogroup(wide.groupBy("shard", "block")).applyInPandas(nearest, "asked long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
