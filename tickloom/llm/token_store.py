"""A store of token ids: documents compressed one by one with a shared zstandard dictionary.

The store is a Parquet table of segments. A segment holds up to SEGMENT_IDS ids of documents that follow each other in
doc_id order: their ids and token counts, the offset index (one more entry than documents), the compressed documents
end to end, the width of an id in bytes and the hash of the dictionary. The dictionary is a table beside the segments.
One document is read by pruning segments on first_doc and last_doc and decompressing one slice.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, new_path, text_of
from tickloom.llm.fast_encode import encoder

SEGMENT_IDS = 1 << 18
SEGMENT = "shard int, segment long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, width int, dictionary string, first_doc long, last_doc long, total long, body binary"


def train_dictionary(docs: DataFrame, tokenizer: str, size: int = 64 << 10, samples: int = 512, sample_ids: int = 4096) -> bytes:
    """A zstandard dictionary from ids of a bounded sample: samples documents, those with the least hash, and of each at
    most sample_ids ids from a hashed place in its text. One executor task trains it; the driver gets the dictionary
    alone. Empty if the sample is too small to train on; zstandard then runs without one."""
    key, wide, total = F.xxhash64("doc_id", "text"), 8 * sample_ids, docs.count()
    drawn = docs.where(F.pmod(key, F.lit(1 << 40)) <= (1 << 40) * min(1.0, 4 * samples / max(total, 1)))  # some 4 x samples rows at any size
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - wide, F.lit(0)) + 1).cast("int")
    some = drawn.select(key.alias("_key"), F.substring("text", at + 1, F.lit(wide)).alias("text")).repartition(1).sortWithinPartitions("_key", "text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder, ids, left = encoder(tokenizer), [], samples
        for batch in batches:
            texts = batch.column("text").to_pylist()[:left]
            left -= len(texts)
            ids += [x[: sample_ids * coder.dtype.itemsize] for x in coder.encode(texts) if x]
        try:
            body = zstandard.train_dictionary(size, ids).as_bytes()
        except zstandard.ZstdError:
            body = b""
        yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["body"])

    return b"".join(bytes(r[0]) for r in some.mapInArrow(train, "body binary").collect())


def write_store(docs: DataFrame, tokenizer: str, end_id: int | None = None, path: str | None = None, level: int = 1) -> str:
    """Encodes whole texts, adds end_id to each, and writes the store; returns its path.

    Rows go in ascending doc_id order (null first), rows of one doc_id by their text's hash. Shards are ranges of both,
    so a doc_id that very many rows have is spread too; a segment is bounded by ids, and a longer document is a segment by
    itself. A null
    text is empty; an empty table gives a store without segments. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    docs = docs.select("doc_id", text_of().alias("text"))
    dictionary = train_dictionary(docs, tokenizer)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "dictionary string, body binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        coder = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], coder.dtype).tobytes()
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        number, ids, counts, frames, total = 0, [], [], [], 0

        def flush():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            known = [i for i in ids if i is not None]
            row = [shard, number, ids, counts, offsets, coder.dtype.itemsize, name, min(known, default=None), max(known, default=None), total, b"".join(frames)]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [f.split()[0] for f in SEGMENT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for lo in range(0, len(texts), 256):
                for key, got in zip(keys[lo : lo + 256], coder.encode(texts[lo : lo + 256]), strict=True):
                    raw = got + end
                    n = len(raw) // coder.dtype.itemsize
                    if ids and total + n > SEGMENT_IDS:
                        yield flush()
                        number, ids, counts, frames, total = number + 1, [], [], [], 0
                    ids.append(key)
                    counts.append(n)
                    frames.append(press.compress(raw))
                    total += n
        if ids:
            yield flush()

    ordered = docs.withColumn("_text", F.xxhash64("text")).repartitionByRange("doc_id", "_text").sortWithinPartitions("doc_id", "_text", "text")
    ordered.mapInArrow(segments, SEGMENT).write.parquet(f"{path}/segments")
    return path


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, width and ids (little-endian bytes) of each document.

    With digest ids_crc32 (of the ids as little-endian unsigned 32-bit integers) stands in place of width and ids.

    With doc_ids only segments that can hold them are read and only those documents are decompressed. A dictionary that
    isn't the one a segment names is an error.
    """
    segments = spark.read.parquet(f"{path}/segments")
    name, body = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(body)
    if hashlib.sha256(dictionary).hexdigest() != name:
        raise ValueError("the dictionary is damaged")
    order = Window.partitionBy("shard").orderBy("segment")
    shards = segments.groupBy("shard").agg(F.sum("total").alias("_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_first"))
    starts = segments.select("shard", "segment", F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_within"))
    starts = starts.join(shards, F.col("shard") == F.col("_shard")).select("shard", "segment", (F.col("_first") + F.col("_within")).alias("start"))
    wanted = None if doc_ids is None else frozenset(doc_ids)
    if wanted is not None:
        fits = [(F.col("first_doc") <= d) & (F.col("last_doc") >= d) for d in sorted(wanted)]
        segments = segments.where(F.exists(F.array(*fits), lambda x: x) if fits else F.lit(False))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError("the segment needs another dictionary")
                counts, at = np.array(row["n_tokens"]), row["offsets"]
                first = np.cumsum(counts) - counts
                take = [i for i, d in enumerate(row["doc_ids"]) if wanted is None or d in wanted]
                if not take:
                    continue
                ids = [press.decompress(row["body"][at[i] : at[i + 1]], max_output_size=int(counts[i]) * row["width"]) for i in take]
                own = [pa.array([row["shard"]] * len(take), pa.int32()), pa.array([row["segment"]] * len(take), pa.int64()), pa.array([row["doc_ids"][i] for i in take], pa.int64()), pa.array(first[take], pa.int64()), pa.array(counts[take], pa.int64())]
                if digest:
                    own.append(pa.array([zlib.crc32(np.frombuffer(x, f"<u{row['width']}").astype("<u4")) for x in ids], pa.int64()))
                else:
                    own += [pa.array([row["width"]] * len(take), pa.int32()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(own, ["_shard", "_segment", "doc_id", "_in", "n_tokens", *(["ids_crc32"] if digest else ["width", "ids"])])

    content = "ids_crc32 long" if digest else "width int, ids binary"
    docs = segments.mapInArrow(documents, f"_shard int, _segment long, doc_id long, _in long, n_tokens long, {content}")
    on = (docs["_shard"] == starts["shard"]) & (docs["_segment"] == starts["segment"])
    return docs.join(starts, on).select("doc_id", (F.col("start") + F.col("_in")).alias("start"), *docs.columns[4:])
