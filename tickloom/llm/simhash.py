"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits stand on a ring of SEGMENTS segments. If two differ in at most BOUND bits, some segment starts a
chain all of whose prefixes of l segments differ in at most l * BOUND / SEGMENTS bits (the pigeonring principle). With
five segments and two bits the budgets are 0, 0, 1, 1, 2: two equal segments in a row (25 or 26 bits) make a candidate,
the rest of the chain prunes it, and only then is the whole distance taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, text_of
from tickloom.llm.components import connected_components

BOUND = 2
#: Widths of the ring's segments, and where each starts (from the low end).
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
SEGMENTS = len(WIDTHS)
#: A bucket of more fingerprints goes by single-bit neighbours.
MOST_IN_BUCKET = 48


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_key (the text's MD5) and fingerprint (long) of whole texts.

    A-Z is lower-cased, words are runs without ASCII blanks, shingles (of words words, repeats included; the whole
    sequence if it has fewer) are hashed with XXH64, seed 42. A bit is 1 if it is so in over half the hashes. No words,
    or a null text: 0. Every row gives a row.
    """

    def of(text: str) -> int:
        from xxhash import xxh64_intdigest

        split = text.encode("utf-8", "surrogatepass").lower().split()
        if not split:
            return 0
        if len(split) <= words:
            return xxh64_intdigest(b" ".join(split), 42)
        joined, counts = b" ".join(split), np.zeros(64, np.int64)
        ends = (np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[: -words]]]
        n = len(starts)
        for lo in range(0, n, 1 << 15):
            h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[lo : lo + (1 << 15)], ends[lo + words - 1 : lo + words - 1 + (1 << 15)], strict=True)], "<u8")
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([of(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(prints)], ["doc_id", "text_key", "fingerprint"])

    return docs.select("doc_id", text_of().alias("text"), F.md5(text_of()).alias("text_key")).mapInArrow(run, "doc_id long, text_key string, fingerprint long")


def segment(f: Column, k: int) -> Column:
    k %= SEGMENTS
    return F.shiftrightunsigned(f, STARTS[k]).bitwiseAND(F.lit((1 << WIDTHS[k]) - 1))


def chain_key(f: Column, k: int) -> Column:
    """Segments k and k + 1 and k itself, in a long."""
    return (F.lit(k) * 64 + 13).cast("long") * (1 << 32) + segment(f, k) * (1 << 13) + segment(f, k + 1)


def links(prints: DataFrame) -> DataFrame:
    """Edges a < b between distinct fingerprints (column fingerprint) whose components are those of all pairs at most BOUND bits apart.

    Buckets of equal chain keys with up to MOST_IN_BUCKET fingerprints give their pairs, which the rest of the chain and
    then the whole distance prune. In a larger bucket all pairs would be too many. There each fingerprint stands with
    its single-bit neighbours (of the bits outside the key): two fingerprints are within two bits just if they share one,
    so a link from each to the least that shares a neighbour loses nothing and makes as many rows as fingerprints have
    bits.
    """
    keyed = prints.select("fingerprint", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), chain_key(F.col("fingerprint"), k).alias("key")) for k in range(SEGMENTS)])).alias("c")).select("fingerprint", "c.k", "c.key")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = cut(keyed.join(sizes, "key"), "simhash-buckets")
    small, large = keyed.where(F.col("n") <= MOST_IN_BUCKET), keyed.where(F.col("n") > MOST_IN_BUCKET)
    bits = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    bucket = small.groupBy("k", "key").agg(F.sort_array(F.collect_list("fingerprint")).alias("all"))  # at most MOST_IN_BUCKET

    def fits(a: Column, b: Column) -> Column:
        """The chain from k keeps its budgets, then the whole distance its own."""
        out = F.lit(False)
        for k in range(SEGMENTS):
            differ, chain = F.lit(0), F.lit(True)
            for l in range(2, SEGMENTS):  # the first two are equal
                differ = differ + bits(segment(a, k + l), segment(b, k + l))
                chain = chain & (differ <= (l + 1) * BOUND // SEGMENTS)
            out = F.when(F.col("k") == k, chain).otherwise(out)
        return out & (bits(a, b) <= BOUND)

    near = F.transform("all", lambda a, i: F.transform(F.filter(F.slice("all", i + 2, MOST_IN_BUCKET), lambda b: fits(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    few = bucket.select(F.explode(F.flatten(near)).alias("e")).select("e.a", "e.b")
    outside = [[x for j in range(2, SEGMENTS) for s in [(k + j) % SEGMENTS] for x in range(STARTS[s], STARTS[s] + WIDTHS[s])] for k in range(SEGMENTS)]
    flip = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit((1 << x) - (1 << 64) * (x == 63)).cast("long") for x in own]) for own in outside])
    around = large.select("key", "fingerprint", F.explode(F.transform(F.element_at(flip, F.col("k") + 1), lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("at"))
    star = around.groupBy("key", "at").agg(F.min("fingerprint").alias("a"), F.collect_set("fingerprint").alias("all"))  # at most one for each outside bit, and itself
    many = star.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    return few.union(many).distinct()


def classes(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_key, fingerprint (long), component (a fingerprint) and component_id for every row."""
    prints = cut(fingerprints(docs, words), "fingerprints")
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    found = connected_components(links(nodes.select("fingerprint")))
    named = nodes.join(found, nodes["fingerprint"] == found["node"], "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "component").select("fingerprint", "component", "component_id"), "fingerprint")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row.

    component_id is the smallest doc_id that links reach, through any number of texts; the row's own if none. Equal
    fingerprints (repeated rows, empty texts) are one node, so their count never matters. A null doc_id is no candidate
    for the smallest: a row without one has the class's id all the same, null if the class has none. An empty table
    gives an empty result.
    """
    return classes(docs, words).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of docs for each class, with all its columns: that of the least doc_id (null last), then text_key.

    Of rows equal in both, one stays. Rows that share a doc_id but not a class stand for classes of their own.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    stay = classes(docs, words).groupBy("component").agg(F.min(order).alias("s")).select(F.col("s.doc_id").alias("_id"), F.col("s.text_key").alias("_key")).distinct()
    keyed = docs.withColumn("_text_key", F.md5(text_of()))
    kept = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["_id"]) & (keyed["_text_key"] == stay["_key"]), "left_semi")
    turn = F.row_number().over(Window.partitionBy("_text_key", "doc_id").orderBy(F.xxhash64(*docs.columns)))
    return kept.withColumn("_turn", turn).where("_turn = 1").drop("_turn", "_text_key")
