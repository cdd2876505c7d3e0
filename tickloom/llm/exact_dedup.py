"""Exact duplicates: rows are grouped by a 128-bit hash of their text, and bytes are compared inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, text_of

#: The ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"


def without_blanks(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def md5_bytes(body: Column) -> Column:
    return F.unhex(F.md5(body))


def keyed(docs: DataFrame, normal: Callable[[Column], Column] = without_blanks, content_hash: Callable[[Column], Column] = md5_bytes, **more: Column) -> DataFrame:
    """row (a number of its own for each row), key (the hash of the normalised text), more columns, and body, that text."""
    text = docs.select(*[c for c in docs.columns if c != "text"], text_of().alias("text"))
    body = normal(F.col("text"))
    return text.select(F.monotonically_increasing_id().alias("row"), content_hash(body).alias("key"), *[c.alias(n) for n, c in more.items()], body.alias("body"))


#: Buckets of the bitmap of repeated keys, and longs of a bucket: 2 ** 26 bits, 8 MB at most.
BUCKETS, WORDS = 1 << 16, 16


def _place(key: Column) -> list[Column]:
    h = F.xxhash64(key)
    return [h.bitwiseAND(F.lit(BUCKETS - 1)).alias("_bucket"), F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(WORDS - 1)).cast("int").alias("_word"), F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(63)).cast("int").alias("_bit")]


def that_may_repeat(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """texts whose keys are in repeated, and a few others: a bitmap of bounded size goes to every task, so texts needn't move.

    The bitmap has a row for each bucket of key hashes that has a repeated key. Beyond some ten million repeated keys it
    lets most rows pass; what follows is then as right, and each text moves once.
    """
    marked = repeated.select(*_place(F.col("key"))).groupBy("_bucket", "_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_set"))
    bits = F.map_from_entries(F.collect_list(F.struct("_word", "_set")))  # WORDS at most
    bitmap = marked.groupBy("_bucket").agg(bits.alias("_m")).select("_bucket", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long"))).alias("_bits"))
    own = texts.select("*", *_place(F.col("key"))).join(F.broadcast(bitmap), "_bucket")
    return own.where("shiftright(_bits[_word], _bit) & 1 = 1").select(*texts.columns)


def collisions(texts: DataFrame, repeated: DataFrame, content_hash: Callable[[Column], Column]) -> DataFrame:
    """Keys of repeated that stand for more than one text.

    Only texts whose keys may repeat are compared: grouping by the bytes leaves one of each text, on the map side first,
    so a group of any number of copies sends one text a task; a text that doesn't repeat has its key alone.
    """
    bodies = that_may_repeat(texts.select("key", "body"), repeated).select("body").distinct()
    return bodies.select(content_hash(F.col("body")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")


def classes(texts: DataFrame, order: Column, finish: Callable[[DataFrame], DataFrame] = lambda df: df.drop("body"), content_hash: Callable[[Column], Column] = md5_bytes) -> tuple[DataFrame, DataFrame]:
    """Rows with a key that equal texts and only these share, and the groups of two rows or more (key, n, first).

    texts: from keyed(). finish makes the small rows that are kept of them (with row and key); first is the least order
    of a group. Where texts collide, their rows are read again and their key is made longer by the least row of the text.
    """

    def groups(of: DataFrame) -> DataFrame:
        return cut(of.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1"), "exact-groups")

    rows = cut(finish(texts), "exact-rows")
    repeated = groups(rows)
    mixed = cut(collisions(texts, repeated, content_hash), "exact-collisions")
    if mixed.isEmpty():
        return rows, repeated
    again = cut(texts.join(mixed, "key", "left_semi").withColumn("row", -1 - F.col("row")), "exact-mixed")
    apart = again.groupBy("key", "body").agg(F.min("row").alias("_least"))
    again = again.join(apart, ["key", "body"]).withColumn("key", F.concat("key", F.unhex(F.hex("_least")))).select(*texts.columns)
    rows = cut(rows.join(mixed, "key", "left_anti").unionByName(finish(again)), "exact-rows")
    return rows, groups(rows)


def exact_duplicates(docs: DataFrame, normal: Callable[[Column], Column] = without_blanks, content_hash: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text) for every row.

    Of equal texts the row with the most code points before normalising stays, then the one with the smallest doc_id
    (null last); of rows that are equal in all that, one. A null text is the empty one, and empty texts are equal like
    others. An empty table gives an empty result; other columns are ignored. Texts move only where their key occurs
    twice or more, one of each task's copies; everything else is a row of some 80 bytes a document.
    """
    more = {"doc_id": F.col("doc_id"), "chars": F.length("text").cast("long"), "sha": F.unhex(F.sha2(normal(F.col("text")), 256))}
    order = F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    rows, groups = classes(keyed(docs, normal, content_hash, **more), order, content_hash=content_hash)
    alone = F.col("n").isNull()
    return rows.join(groups, "key", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, normal: Callable[[Column], Column] = without_blanks) -> DataFrame:
    """docs without the rows that exact_duplicates drops; doc_ids must be unique, rows that share one stay or go together."""
    gone = exact_duplicates(docs, normal).where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
