"""How filters overlap: what each removes after any others, from a packed bitmap index.

Each partition packs one bit a row for every filter, label and part into NumPy bitsets. For every subset of the filters
the rows of a part that pass all of it are the part's bits AND NOT the subset's, counted by popcount; these counts are
summed over partitions, and whatever an order of the filters does follows from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import text_of
from tickloom.llm.exact_dedup import classes, keyed

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Rows that are packed at a time, and parts whose counts a task holds.
ROWS, PARTS = 1 << 16, 1 << 12
UPPER, SIGNS = bytes(range(65, 91)), b"#$%&*|"
COUNTS = "part string, subset int, kept long, good long, toxic long"


def fails_of(text: str) -> int:
    """Bits of the filters A to D that a text fails: few words, few distinct words, many capitals, odd signs."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    few = len(words) < 200
    repeats = 100 * len(set(words)) < 50 * len(words)
    capitals = 100 * (len(raw) - len(raw.translate(None, UPPER))) > 2 * len(text)
    signs = len(raw.translate(None, SIGNS)) < len(raw)
    return few | repeats << 1 | capitals << 2 | signs << 3


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fails = pa.array([fails_of(t) for t in b.column("body").to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "key", "doc_id", "part")], fails], ["row", "key", "doc_id", "part", "fails"])


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (a bit for each filter), good and toxic for every row of docs.

    Filter E is a smaller doc_id with the same text anywhere in the table: of equal texts (md5, bytes compared inside
    its groups) all but the least doc_id fail; rows that share that doc_id pass, and so do rows without one. A document
    is good or toxic if any of its labels says so; one without an id has none. A null text is the empty one, a null source the part ''.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    part = F.coalesce("source", F.lit(""))
    texts = keyed(docs, lambda text: text, doc_id=F.col("doc_id"), part=part)
    finish = lambda df: df.mapInArrow(_flag, f"row long, key binary, doc_id {kind}, part string, fails int")
    rows, groups = classes(texts, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"), finish)
    marks = labels.groupBy(F.col("doc_id").alias("_of")).agg(*[F.max((F.coalesce(c, F.lit(0)) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    later = F.coalesce(F.col("doc_id") > F.col("first.doc_id"), F.lit(False))
    fails = F.col("fails") + F.when(later, 1 << 4).otherwise(0)
    known = rows.join(groups, "key", "left").select("doc_id", "part", fails.alias("fails"))
    return known.join(marks, known["doc_id"] == marks["_of"], "left").select("part", "fails", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def packed(bits: np.ndarray) -> np.ndarray:
    """Words of 64 bits of a boolean array whose length is a multiple of 64."""
    return np.packbits(bits, bitorder="little").view(np.uint64)


def index_counts(part: np.ndarray, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct parts, and for each and every subset of the filters the rows that pass it: all, good and toxic ones."""
    names, code = np.unique(part, return_inverse=True)
    order = np.argsort(code, kind="stable")  # rows of a part lie together, so its bitset is empty but for one stretch
    pad = (-len(order)) % 64
    line = lambda x: packed(np.concatenate([x[order], np.zeros(pad, bool)]))
    failing = [line((fails >> i & 1).astype(bool)) for i in range(len(FILTERS))]
    kinds = [line(x.astype(bool)) for x in (good, toxic)]
    union = [np.zeros_like(kinds[0])]
    for s in range(1, SUBSETS):
        union.append(union[s & (s - 1)] | failing[(s & -s).bit_length() - 1])
    code = np.concatenate([code[order], np.full(pad, -1)])
    bounds = np.searchsorted(code[: len(order)], np.arange(len(names) + 1))
    out = np.zeros((len(names), SUBSETS, 3), np.int64)
    for p in range(len(names)):
        lo, hi = bounds[p] // 64, -(-bounds[p + 1] // 64)
        own = packed(code[lo * 64 : hi * 64] == p)
        for s in range(SUBSETS):
            left = own & ~union[s][lo:hi]
            out[p, s] = [np.bitwise_count(x).sum(dtype=np.int64) for x in (left, left & kinds[0][lo:hi], left & kinds[1][lo:hi])]
    return names, out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        names = np.repeat(np.array(list(sums), object), SUBSETS)
        each = np.concatenate(list(sums.values()))
        columns = [pa.array(names, pa.string()), pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(sums))), *[pa.array(np.ascontiguousarray(each[:, i])) for i in range(3)]]
        sums.clear()
        return pa.RecordBatch.from_arrays(columns, ["part", "subset", "kept", "good", "toxic"])

    def add(held: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(held)
        column = lambda c: rows.column(c).to_numpy()
        names, counts = index_counts(np.array(rows.column("part").to_pylist(), object).astype(str), column("fails"), column("good"), column("toxic"))
        for name, own in zip(names.tolist(), counts, strict=True):
            sums[name] = sums.get(name, 0) + own

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            add(held)
            held, n = [], 0
            if len(sums) > PARTS:
                yield flush()
    if n:
        add(held)
    if sums:
        yield flush()


def subset_counts(flagged: DataFrame) -> DataFrame:
    """part, subset (bits of filters) and how many rows of the part pass all filters of the subset: kept, good, toxic."""
    return flagged.mapInArrow(_count, COUNTS).groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])


def interactions(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order of the filters."""
    by_subset = F.sort_array(F.collect_list(F.struct("subset", "kept", "good", "toxic")))  # one for each subset
    at = lambda c, i: F.get(c, i if isinstance(i, Column) else F.lit(i))
    parts = counts.groupBy("part").agg(by_subset.alias("c")).select("part", *[F.col(f"c.{x}").alias(f"_{x}") for x in ("kept", "good", "toxic")])
    shapley = []
    for f in range(len(FILTERS)):
        others = [s for s in range(SUBSETS) if not s >> f & 1]
        times = {s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) for s in others}
        shapley.append(sum((times[s] * (at("_kept", s) - at("_kept", s | 1 << f)) for s in others), F.lit(0).cast("long")))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.withColumn("_shapley", F.array(*shapley)).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    own = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    steps = steps.withColumns({"_before": before, "_own": own}).withColumn("_bit", F.expr("shiftleft(1, _own)"))
    then = F.col("_before") + F.col("_bit")
    lost = lambda c: at(c, F.col("_before")) - at(c, then)
    failing = at("_kept", 0) - at("_kept", F.col("_bit"))
    rest = SUBSETS - 1 - F.col("_bit")
    return steps.select(
        "part", "filter_order", "step", at("_kept", then).alias("kept"), lost("_kept").alias("removed"), (failing - lost("_kept")).alias("redundant"),
        (at("_kept", rest) - at("_kept", SUBSETS - 1)).alias("unique_fails"), lost("_good").alias("good_lost"), lost("_toxic").alias("toxic_lost"), at("_shapley", F.col("_own")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step.

    Counts within the part: kept after the step, removed by it, redundant (failing its filter but removed before),
    unique_fails (failing its filter only), good_lost and toxic_lost (removed here and labelled so) and shapley (its
    filter's removals, summed over all orders). A table without rows has no parts and gives no rows; repeated rows count
    each; other columns of docs are ignored. How rows are judged: see flags().
    """
    return interactions(subset_counts(flags(docs.select("doc_id", "text", "source"), labels)))
