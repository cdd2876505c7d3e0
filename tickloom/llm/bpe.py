"""Byte-level BPE by Spark higher-order functions.

A task collects the distinct words of its share of the texts (Python, Arrow batches), Spark folds the ranked merges over
the byte array of each new word with a literal rank map, and concatenates the binary pieces of the ids for decoding; the
task then puts the texts together from its words (Python again). All three run in one stage, nothing is shuffled, and
what a task holds is bounded by MOST_WORDS. Words that are frequent in a sample of documents are folded once, before, and
sent to all tasks: HOT_WORDS of HOT_LENGTH characters at most. They only save folds; any other word is folded where it occurs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import cut, text_of
from tickloom.llm.fast_encode import PIECE

#: Words that a task knows at a time, and characters of text that go to Spark at once.
MOST_WORDS, CHUNK = 300_000, 2 << 20
#: Words of ASCII up to this size hardly ever have a place to be cut.
PLAIN_BYTES = 24
HOT_WORDS, HOT_LENGTH, HOT_DOCUMENTS = 400_000, 24, 48_000
#: Factors of the rank map's slot for a pair of ids.
LEFT, RIGHT = 40503, 2654435


class Vocabulary(NamedTuple):
    ranks: dict[bytes, int]
    pattern: str


def load(path: str, pattern: str) -> Vocabulary:
    """A rank file: base64 of a token and its rank in each line."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The id that each mergeable pair of ids becomes, which is its rank."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


def rank_tables(pairs: dict[tuple[int, int], int]) -> list[np.ndarray]:
    """The rank map as tables of left << 32 | right << 16 | rank by slot; a pair that finds its slot taken goes to the next table."""
    sizes, tables = [524287, 131071, 32749, 8191, 2039, 509, 127], []
    while pairs:
        size = sizes[len(tables)] if len(tables) < len(sizes) else 127
        own, rest = np.full(size, -1, np.int64), {}
        for (a, b), rank in pairs.items():
            at = (a * LEFT + b * RIGHT) % size
            if own[at] < 0:
                own[at] = a << 32 | b << 16 | rank
            else:
                rest[a, b] = rank
        tables.append(own)
        pairs = rest
    return tables


def literal_longs(spark: SparkSession, values: np.ndarray) -> Column:
    """An array literal in Spark's compact form, which plans don't spell out when they are printed."""
    jvm = spark.sparkContext._jvm
    held = spark.sparkContext._gateway.new_array(jvm.long, len(values))
    jvm.java.nio.ByteBuffer.wrap(values.astype(">i8").tobytes()).asLongBuffer().get(held)
    types, catalyst = jvm.org.apache.spark.sql.types.DataTypes, jvm.org.apache.spark.sql.catalyst.expressions
    literal = catalyst.Literal(catalyst.UnsafeArrayData.fromPrimitiveArray(held), types.createArrayType(types.LongType, False))
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def fold(spark: SparkSession, vocabulary: Vocabulary):
    """A function from a word's bytes (array of 0 to 255) to its ids: the pair of least rank merges, the leftmost of
    equals, until none is left. Each step of the fold makes one merge."""
    if max(vocabulary.ranks.values()) >= 1 << 16:
        raise ValueError("ranks must be below 65536")
    tables = rank_tables(merges(vocabulary.ranks))
    literals = [literal_longs(spark, t) for t in tables]
    single = literal_longs(spark, np.array([vocabulary.ranks[bytes([i])] for i in range(256)]))

    def rank(a: Column, b: Column) -> Column:
        key, slot, out = a * 65536 + b, a * LEFT + b * RIGHT, F.lit(None).cast("long")
        for table, lit in zip(reversed(tables), reversed(literals), strict=True):
            x = F.get(lit, (slot % len(table)).cast("int"))
            out = F.when(F.shiftright(x, 16) == key, x.bitwiseAND(F.lit(65535))).when(x >= 0, out)
        return out

    def merged(s: Column) -> Column:
        n = F.size(s)
        pairs = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), rank)

        def put(ranks: Column) -> Column:
            least = F.array_min(ranks)
            at = F.array_position(ranks, least).cast("int")
            whole = F.concat(F.slice(s, F.lit(1), at - 1), F.array(least), F.slice(s, at + 2, n))
            return F.when(least.isNull(), F.concat(s, F.array(F.lit(-1).cast("long")))).otherwise(whole)  # -1 at the end: done

        return F.element_at(F.transform(F.array(pairs), put), 1)

    def ids(word: Column) -> Column:
        start = F.transform(word, lambda b: F.get(single, b.cast("int")))
        steps = F.aggregate(F.sequence(F.lit(1), F.size(word)), start, lambda s, _: F.when((F.size(s) < 2) | (F.element_at(s, -1) < 0), s).otherwise(merged(s)))
        return F.when(F.size(word) == 0, start).otherwise(F.filter(steps, lambda i: i >= 0))

    return ids


def unfold(spark: SparkSession, vocabulary: Vocabulary):
    """A function from ids to their bytes: the binary pieces, concatenated."""
    pieces = sorted(vocabulary.ranks.items(), key=lambda x: x[1])
    sizes = np.zeros(pieces[-1][1] + 2, np.int64)
    for token, rank in pieces:
        sizes[rank + 1] = len(token)
    starts = literal_longs(spark, np.cumsum(sizes))
    blob = F.lit(bytearray(b"".join(t for t, _ in pieces)))

    def piece(i: Column) -> Column:
        lo = F.get(starts, i.cast("int"))
        return F.substring(blob, (lo + 1).cast("int"), (F.get(starts, (i + 1).cast("int")) - lo).cast("int"))

    return lambda ids: F.aggregate(ids, F.lit(bytearray()), lambda s, i: F.concat(s, piece(i)))


class Joints(NamedTuple):
    """What of the tokens decides whether one can span a place: adjacent bytes, with the byte before or after, or at a token's start or end."""

    pairs: frozenset[bytes]
    triples: frozenset[bytes]
    starts: frozenset[bytes]
    ends: frozenset[bytes]


def joints(ranks: dict[bytes, int]) -> Joints:
    tokens = [t for t in ranks if len(t) > 1]
    pairs = frozenset(t[i : i + 2] for t in tokens for i in range(len(t) - 1))
    triples = frozenset(t[i : i + 3] for t in tokens for i in range(len(t) - 2))
    return Joints(pairs, triples, frozenset(t[:2] for t in tokens), frozenset(t[-2:] for t in tokens))


def cuts(word: bytes, j: Joints) -> list[bytes]:
    """word cut where no token can span the place: no merge can either, so the ids are those of the parts.

    A token that spans it has the bytes on both sides, and either starts with them or has the byte before too; likewise after.
    """
    out, start, n = [], 0, len(word)
    for i in range(1, n):
        two = word[i - 1 : i + 1]
        left = two in j.starts or (i > 1 and word[i - 2 : i + 1] in j.triples)
        if not (two in j.pairs and left and (two in j.ends or (i + 1 < n and word[i - 1 : i + 2] in j.triples))):
            out.append(word[start:i])
            start = i
    out.append(word[start:])
    return out


WORDS = "fresh boolean, doc_id array<long>, sizes array<int>, places binary, words array<array<int>>, counts array<int>, parts binary"


def splitter(pattern: str, ranks: dict[bytes, int]):
    """A function from a piece of text to the byte arrays of its words, each cut where that changes nothing."""
    import regex

    split = regex.compile(pattern).findall
    seams = joints(ranks)

    def parts_of(piece: str) -> list[bytes]:
        out = []
        for word in split(piece):
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) <= PLAIN_BYTES and raw.isascii():
                out.append(raw)
            else:
                out += cuts(raw, seams)
        return out

    return parts_of


def byte_arrays(words: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int32)))


def hot_words(docs: DataFrame, vocabulary: Vocabulary, ids, bytes_, digest: bool) -> tuple[bytes, bytes]:
    """The most frequent pieces of HOT_DOCUMENTS documents (those whose doc_id has the least hash) with what they encode to:
    two Arrow tables, serialized, which is how the driver holds and sends them."""
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(HOT_DOCUMENTS).distinct()
    some = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(PIECE.findall(text))
        kept = {p: n for p, n in seen.items() if len(p) <= HOT_LENGTH}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["piece", "n"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of = splitter(pattern, ranks)
        for batch in batches:
            parts = [parts_of(p) for p in batch.column("piece").to_pylist()]
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(ends), byte_arrays([w for p in parts for w in p]))
            yield pa.RecordBatch.from_arrays([batch.column("piece"), words], ["piece", "words"])

    pattern, ranks = vocabulary.pattern, vocabulary.ranks
    counted = some.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    frequent = cut(counted.orderBy(F.desc("n"), "piece").limit(HOT_WORDS).select("piece"), "hot-words").repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)
    folded = frequent.mapInArrow(cut_up, "piece string, words array<array<int>>").select("piece", F.flatten(F.transform("words", ids)).alias("ids")).withColumn("decoded", bytes_(F.col("ids")))

    def code_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codes_of(digest)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array([len(x) for x in lists], pa.int32()), pa.array([code(x) for x in lists], pa.binary()), batch.column("decoded")], ["piece", "n", "coded", "raw"])

    rows = folded.mapInArrow(code_up, "piece string, n int, coded binary, raw binary").toArrow()  # HOT_WORDS at most
    return packed(rows.select(["piece"])), packed(rows.select(["n", "coded", "raw"]))


def packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> list[list]:
    """The columns of a packed table."""
    return [c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns]


def codes_of(digest: bool):
    """A function from ids to how results carry them: decimal text, or 32-bit integers."""
    return (lambda x: " ".join(map(str, x)).encode()) if digest else (lambda x: np.array(x, np.int32).tobytes())


def collect_words(pattern: str, ranks: dict[bytes, int], hot):
    """Texts to chunks: new distinct parts of words as byte arrays, pieces of text as numbers of parts, texts as numbers of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of = splitter(pattern, ranks)
        hot_numbers = lambda: {p: i for i, p in enumerate(unpacked(hot.value)[0])}
        number: dict[str, int] = hot_numbers()
        shared: dict[bytes, int] = {}  # parts of pieces that have several
        keys, texts, size, fresh, total = [], [], 0, True, 0

        def chunk() -> pa.RecordBatch:
            nonlocal total
            places, sizes, counts, parts, words = [], [], [], [], []
            for text in texts:
                pieces = PIECE.findall(text)
                for p in {p for p in pieces if p not in number}:
                    number[p] = len(number)
                    own = parts_of(p)
                    if len(own) == 1:  # number holds it already
                        parts.append(total)
                        words.append(own[0])
                        total += 1
                    else:
                        for c in own:
                            if c not in shared:
                                shared[c] = total
                                words.append(c)
                                total += 1
                            parts.append(shared[c])
                    counts.append(len(own))
                sizes.append(len(pieces))
                places.append(np.fromiter(map(number.__getitem__, pieces), np.int32, len(pieces)).tobytes())
            whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), byte_arrays(words))
            row = [pa.array([fresh]), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(places)], pa.binary()), whole, pa.array([counts], pa.list_(pa.int32())), pa.array([np.array(parts, np.int32).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["fresh", "doc_id", "sizes", "places", "words", "counts", "parts"])

        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                keys.append(key)
                texts.append(text)
                size += len(text)
                if size >= CHUNK:
                    yield chunk()
                    keys, texts, size, fresh = [], [], 0, False
                    if total > MOST_WORDS:
                        number, shared, fresh, total = hot_numbers(), {}, True, 0
        if keys:
            yield chunk()

    return run


def assemble(digest: bool, hot):
    """Chunks with ids and decoded pieces of their words to a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        glue = b" " if digest else b""
        text = [str(i).encode() for i in range(1 << 16)] if digest else [i.to_bytes(4, "little") for i in range(1 << 16)]
        ids, raw, size, piece_ids, piece_raw, piece_n = [], [], [], [], [], []
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c)[r] for c in batch.schema.names}
                if one["fresh"].as_py():
                    ids, raw, size = [], [], []
                    piece_n, piece_ids, piece_raw = unpacked(hot.value)
                lists = one["ids"].values
                ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
                flat = lists.flatten().to_pylist()
                for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                    ids.append(text[flat[lo]] if hi - lo == 1 else glue.join([text[i] for i in flat[lo:hi]]))
                    size.append(hi - lo)
                raw += one["decoded"].values.to_pylist()
                parts, at = np.frombuffer(one["parts"].as_py(), np.int32).tolist(), 0
                for n in one["counts"].as_py():
                    if n == 1:
                        p = parts[at]
                        piece_n.append(size[p])
                        piece_ids.append(ids[p])
                        piece_raw.append(raw[p])
                    else:
                        own = parts[at : at + n]
                        piece_n.append(sum([size[p] for p in own]))
                        piece_ids.append(glue.join([ids[p] for p in own]))
                        piece_raw.append(b"".join([raw[p] for p in own]))
                    at += n
                places, at, rows = np.frombuffer(one["places"].as_py(), np.int32).tolist(), 0, []
                for n in one["sizes"].as_py():
                    own = places[at : at + n]
                    at += n
                    decoded = b"".join([piece_raw[p] for p in own])
                    coded = glue.join([piece_ids[p] for p in own])
                    total = sum([piece_n[p] for p in own])
                    rows.append((total, hashlib.sha256(coded).hexdigest(), hashlib.sha256(decoded).hexdigest()) if digest else (np.frombuffer(coded, np.int32), decoded))
                cols = list(zip(*rows, strict=True))
                keys = pa.array(one["doc_id"].as_py(), pa.int64())
                if digest:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, digest: bool = False) -> DataFrame:
    """doc_id, ids and decoded (their bytes again) of every row of docs; with digest n_tokens, ids_sha256 (of the decimal
    ids joined by one space) and decoded_sha256 instead.

    Texts are whole; a null text is empty and has no ids. Repeated rows and null doc_ids give rows of their own; other
    columns don't matter; an empty table gives an empty result. A word of n bytes that no cut divides takes up to n steps over n ids.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_of().alias("text"))
    ids, bytes_ = fold(spark, vocabulary), unfold(spark, vocabulary)
    pieces, codes = map(spark.sparkContext.broadcast, hot_words(texts, vocabulary, ids, bytes_, digest))
    words = texts.mapInArrow(collect_words(vocabulary.pattern, vocabulary.ranks, pieces), WORDS)
    folded = words.withColumn("ids", F.transform("words", ids)).withColumn("decoded", F.transform("ids", bytes_)).drop("words")
    content = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    return folded.mapInArrow(assemble(digest, codes), f"doc_id long, {content}")
