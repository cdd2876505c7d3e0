"""Runs of repeating word sequences, by comparing the word ids of a text with every shift of themselves.

A run is a stretch of words with smallest period q that is at least max(LEAST_WORDS, LEAST_TIMES * q) long and that no
neighbouring word extends. For each lag q up to n / LEAST_TIMES the ids are compared with themselves q places on; a
stretch of equal places of length l is a stretch of period q of length l + q.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, cut, text_of

LEAST_TIMES, LEAST_WORDS = 4, 6
#: Lags of one range: a text of more words than LEAST_TIMES as many is scanned in ranges of lags, by different tasks.
LAGS = 4096
RUNS = "array<struct<start:long,length:long,period:long>>"
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int32)


def least_equal(q: int, times: int = LEAST_TIMES) -> int:
    """The equal places that a run of period q has at least."""
    return max(LEAST_WORDS - q, (times - 1) * q)


def possible_lags(ids: np.ndarray, lo: int, hi: int, times: int = LEAST_TIMES) -> np.ndarray:
    """Lags lo to hi - 1 that can have a run, all at once. A run's equal places hold times - 1 multiples of the lag in a
    row, so a lag without these has none: places 0, q, 2q... are compared, n / q of them instead of n."""
    q = np.arange(lo, hi)
    fits, streak = np.zeros(len(q), bool), np.zeros(len(q), np.int32)
    k, last = 0, len(ids) - 1
    while (m := int(np.searchsorted(q, last // (k + 1), side="right"))) > 0:
        at = q[:m] * k
        streak[:m] = (streak[:m] + 1) * (ids[at] == ids[at + q[:m]])
        fits[:m] |= streak[:m] >= times - 1
        k += 1
    return q[fits]


def scan(ids: np.ndarray, lo: int, hi: int, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the stretches of each lag from lo to hi - 1 that are long enough; a stretch can appear
    again with multiples of its period."""
    n, out = len(ids), []
    hi = min(hi, n // times + 1)
    direct = min(hi, max(lo, 8, int(2 * n**0.5)))  # below, comparing all places is cheaper than the test of multiples
    for q in [*range(lo, direct), *(possible_lags(ids, direct, hi, times).tolist() if direct < hi else [])]:
        equal = ids[q:] == ids[:-q]
        least = least_equal(q, times)
        if np.count_nonzero(equal) < least:
            continue
        edges = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        for i in np.flatnonzero(lengths >= least).tolist():
            out.append((int(starts[i]), int(lengths[i]) + q, q))
    return out


def primitive(stretches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """By start and period, with the smallest period of each stretch: where a stretch of at least twice a period has a
    smaller one, that divides it, and the stretch is maximal for both."""
    least: dict[tuple[int, int], int] = {}
    for start, length, q in stretches:
        least[start, length] = min(q, least.get((start, length), q))
    return sorted(((s, l, q) for (s, l), q in least.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _records(runs: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": s, "length": l, "period": q} for s, l, q in runs]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one range of lags: runs and what is left."""
    for b in batches:
        runs, left = [], []
        for text in b.column("text").to_pylist():
            words = text.encode("utf-8", "surrogatepass").split()
            own = primitive(scan(word_ids(words), 1, len(words)))
            runs.append(_records(own))
            left.append(collapse(words, own).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(runs, ARROW_RUNS), pa.array(left, pa.string())], ["doc_id", "runs", "collapsed"])


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of lags of a text."""
    for b in batches:
        for i, text in enumerate(b.column("text")):
            lo, hi = b.column("lo")[i].as_py(), b.column("hi")[i].as_py()
            found = primitive(scan(word_ids(text.as_py().encode("utf-8", "surrogatepass").split()), lo, hi))
            yield pa.RecordBatch.from_arrays([b.column("row").slice(i, 1), pa.array([_records(found)], ARROW_RUNS)], ["row", "runs"])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of a text whose ranges are gathered."""
    for b in batches:
        for i, text in enumerate(b.column("text")):
            own = primitive([(r["start"], r["length"], r["period"]) for r in b.column("runs")[i].as_py()])
            left = collapse(text.as_py().encode("utf-8", "surrogatepass").split(), own).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), pa.array([_records(own)], ARROW_RUNS), pa.array([left], pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, lags: int = LAGS) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start, then period) and collapsed for every row.

    collapsed has the words that no run contains after its first period, joined by one space. A null text is the empty
    one, which has no runs; a null or repeated doc_id is kept as it is; other columns are ignored; an empty table gives
    an empty result. Texts that may have more than lags lags (by their bytes: a word takes two at least) are written
    once, and each range of lags of a text goes to a task of its own with the text, which is read there anew; so the
    longest text takes as many tasks as it has ranges. All others are scanned where they are read, without a shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of().alias("text"))
    short = F.octet_length("text") < 2 * LEAST_TIMES * lags
    result = f"doc_id {kind}, runs {RUNS}, collapsed string"
    long_ = cut(texts.where(~short).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    last = F.floor(F.regexp_count("text", F.lit(WORD)) / LEAST_TIMES)
    ranges = long_.select("row", "text", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(last, F.lit(1).cast("long")), F.lit(lags).cast("long"))).alias("lo"))
    ranges = ranges.withColumn("hi", F.col("lo") + lags).repartition("row", "lo")
    found = ranges.mapInArrow(_range, f"row long, runs {RUNS}").groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    gathered = long_.join(found, "row").select("doc_id", "text", "runs").mapInArrow(_collapsed, result)
    return texts.where(short).mapInArrow(_whole, result).unionByName(gathered)


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of periodic_runs: n_runs, the run with the greatest exact length / period (then the smallest
    start, then period), and SHA-256 of all runs and of the words left."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda b, r: F.when(more(b, r), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    named = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return named.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("(b.length * 1000) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
