"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target number of words; a document's expected copies are its source's target over its source's size.
Documents of a source stand in a fixed order, expected copies are summed up along it, one random offset is added, and a
document is emitted once for each integer that its stretch of the sum crosses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, cut, text_of

#: Parts of each size class of a source, so that no task holds a whole hot source: so many, and one for each PART_ROWS rows.
SALTS, PART_ROWS = 64, 1_000_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size and target for a table of source and source_size, one row a source.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target stops at cap
    times its source's size, and what is above goes to the others by weight. That end state is min(cap * size, level *
    weight) with one level for all: with sources by rising cap * size / weight, the level is what is left per weight
    at the first source that doesn't reach its stop.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    s = s.withColumn("stop", cap * F.col("source_size")).withColumn("ratio", F.col("stop") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / rest)
    level = F.coalesce(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)["level"], F.lit(0.0))
    return s.withColumn("target", F.least("stop", level * F.col("weight"))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 42, keep_text: bool = True) -> DataFrame:
    """docs with size, source_size, target and copies, the times that the mix takes each.

    The order within a source is by size class (powers of two), part, doc_id and text, so the sample is spread over sizes
    and a source's words come near its target. Parts are hashes of doc_id and text: the prefix sum is taken within (source, class,
    part) and the sums of the parts before are added, so no task holds more than a part. The offset is a hash of source
    and seed, so reruns agree. A null text has size 0; a null source is a source; a null doc_id and repeated rows are
    rows like any other (which of equal rows is taken makes no difference). Documents of size 0 share their source's
    rate. An empty table gives an empty result; columns with the added names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies") and (keep_text or c != "text")]
    salts = max(SALTS, -(-docs.count() // PART_ROWS))
    docs = docs.select(F.struct(*keep).alias("_doc"), "doc_id", "source", word_count(text_of()).alias("size"), F.md5(text_of()).alias("_text"))
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_text")), 1, 8), 16, 10)
    key = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))  # joins and windows share one partitioning
    docs = docs.withColumns({"_key": key, "_class": F.length(F.bin("size")), "_part": digits.cast("long") % salts})
    at = ["_key", "_class", "_part"]
    groups = cut(docs.groupBy("source", *at).agg(F.count("*").alias("_rows"), F.sum("size").alias("_words")), "mix-groups")
    targets = source_targets(groups.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, cap)
    before = Window.partitionBy("_key").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    same = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))
    spread = groups.drop("source").join(targets.withColumn("_key", same), "_key").withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    offset = F.conv(F.substring(F.md5(F.concat("_key", F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / 2.0**32
    rate = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)), F.lit(cap))
    spread = spread.select(*at, "source_size", "target", "_before", rate.alias("_rate"), offset.alias("_offset"))
    ranked = docs.withColumn("_rank", F.row_number().over(Window.partitionBy(*at).orderBy("doc_id", "size", "_text")))
    upto = lambda n: F.floor((F.col("_before") + n) * F.col("_rate") + F.col("_offset"))
    copies = F.least(upto(F.col("_rank")) - upto(F.col("_rank") - 1), F.lit(int(cap)))
    return ranked.join(spread, at).select("_doc.*", "size", "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """A row of mixed once for each of its copies, without the columns that mix_sources added."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").withColumn("_copy", times).drop("_copy", "size", "source_size", "target", "copies")
