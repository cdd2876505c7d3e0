"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: of words (1 and 2) and of word shapes (1 to 4), where a shape says how a word
is written and whether it repeats the one before. Each indicator is scaled by the log-count ratio of the classes,
counted by Spark over all labelled rows; a linear hinge-loss model is then fitted by dual coordinate descent on a
bounded sample, and a logistic curve turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import text_of

BITS = 18
BUCKETS = 1 << BITS
#: Classes of bytes: blank, upper, lower, digit, full stops and commas, other signs, bytes of longer characters.
BLANK, UPPER, LOWER, DIGIT, STOP, SIGN, WIDE = range(7)
KIND = np.full(256, SIGN, np.uint8)
KIND[128:] = WIDE
KIND[[32, *range(9, 14)]] = BLANK
KIND[65:91], KIND[97:123], KIND[48:58] = UPPER, LOWER, DIGIT
KIND[[ord(c) for c in ".,;:'\"()?-"]] = STOP
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Powers of an odd number by place in a word; from the 64th byte on they repeat.
POWERS = np.array([pow(0x100000001B3, k, 1 << 64) for k in range(64)], np.uint64)


class Model(NamedTuple):
    weights: np.ndarray  # float32, one for each bucket, times the log-count ratio
    bias: float
    slope: float
    offset: float


#: Without labels of both classes: 1/2 everywhere.
UNFITTED = Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def indicators(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs of a list of texts, sorted by text number."""
    raws = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(raws), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KIND[data]
    solid = kind != BLANK
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.searchsorted(np.cumsum([len(r) for r in raws]), starts, side="right")
    length = ends - starts
    place = np.arange(len(data))
    place[starts[0] :] -= np.repeat(starts, np.diff(starts, append=len(data)))
    lower = np.where(kind == UPPER, data + np.uint8(32), data).astype(np.uint64) + np.uint64(1)
    lower *= POWERS[place & 63]
    lower[~solid] = 0
    word = mixed(np.add.reduceat(lower, starts))
    has = np.bitwise_or.reduceat(np.uint8(1) << kind * solid, starts) & np.uint8(0x7E)
    first = kind[starts]
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    shape = mixed(has.astype(np.uint64) | (first.astype(np.uint64) << np.uint64(8)) | (np.minimum(length, 4).astype(np.uint64) << np.uint64(12)) | (same.astype(np.uint64) << np.uint64(16)) | np.uint64(1 << 40))
    found = []
    for unit, longest, salt in ((word, 2, 1), (shape, 4, 5)):
        gram = unit
        for n in range(1, longest + 1):
            if n > 1:
                gram = mixed(gram[:-1] * np.uint64(0x100000001B3) + unit[n - 1 :])
            inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
            bucket = (gram + np.uint64(salt + n)) * MIX >> np.uint64(64 - BITS)
            found.append((owner[n - 1 :][inside].astype(np.int64) << BITS) | bucket[inside].astype(np.int64))
    pairs = np.concatenate(found)
    pairs.sort()
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    return pairs >> BITS, pairs & (BUCKETS - 1)


def groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about most characters, each with the place of its first."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most:
            yield lo, texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def hinge_fit(owner: np.ndarray, bucket: np.ndarray, ratio: np.ndarray, y: np.ndarray, c: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent (Hsieh et al., 2008) for the L1 hinge loss; rows have unit length and a bias feature."""
    n = len(y)
    ends = np.searchsorted(owner, np.arange(n + 1))
    values = ratio.astype(np.float32)[bucket]
    rows = [(bucket[a:b], values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    for _, v in rows:  # views: lengths are set in place
        v /= max(float(np.sqrt(v @ v)), 1e-12)
    q = np.array([float(v @ v) + 1 for _, v in rows])
    upper = np.where(y > 0, c * n / (2 * max((y > 0).sum(), 1)), c * n / (2 * max((y < 0).sum(), 1)))  # balanced classes
    w, bias, alpha, rng = np.zeros(len(ratio)), 0.0, np.zeros(n), np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(n):
            at, v = rows[i]
            slack = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - slack / q[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_chars: int = 8_000_000, c: float = 1.0, rounds: int = 30, seed: int = 7) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, label 0 or 1; other values and nulls don't count).

    Class counts of n-grams are taken over all labelled rows, in an aggregate of at most 2^18 buckets. The hinge-loss
    model and the curve are fitted on sample rows at most, half of each class where there are so many: those whose
    doc_id has the least hash, whole, and together sample_chars characters at most (a text over a twentieth of that isn't
    drawn); one executor task fits them. Without labels of both classes the
    score is 1/2 everywhere. Rows that repeat count as often as they occur; labels of a doc_id that disagree are dropped.
    """
    one = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_max")).where("label = _max").select("doc_id", "label")
    rows = docs.select("doc_id", text_of().alias("text")).join(one.hint("merge"), "doc_id")  # one plan at every size

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            y = np.array(b.column("label").to_pylist(), np.int64)
            seen += np.bincount(y, minlength=2)
            for lo, some in groups(b.column("text").to_pylist()):
                owner, bucket = indicators(some)
                total += np.bincount(y[lo + owner] * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, BUCKETS)
        if seen.sum():
            at = np.flatnonzero(total.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[0, at], seen[0])), pa.array(np.append(total[1, at], seen[1]))], ["bucket", "n0", "n1"])

    table = rows.mapInArrow(counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # 2^18 rows at most
    at, n0, n1 = (table.column(c).to_numpy() for c in ("bucket", "n0", "n1"))
    seen = (n0[at < 0].sum(), n1[at < 0].sum())
    if not min(seen):
        return UNFITTED
    count = np.zeros((2, BUCKETS))
    count[:, at[at >= 0]] = n0[at >= 0], n1[at >= 0]
    ratio = np.log((count[1] + 1) / (count[1] + 1).sum()) - np.log((count[0] + 1) / (count[0] + 1).sum())
    ratio[count.sum(0) == 0] = 0

    order = F.xxhash64("doc_id", F.lit(seed))
    parts = [one.where(F.col("label") == y).orderBy(order, "doc_id").limit(sample // 2) for y in (0, 1)]
    drawn = rows.join(F.broadcast(parts[0].union(parts[1]).select("doc_id")), "doc_id", "left_semi").select("label", "text", order.alias("_order"), F.length("text").alias("_size")).where(F.col("_size") <= sample_chars // 20)
    upto = F.sum("_size").over(Window.partitionBy("label").orderBy("_order", "text").rowsBetween(Window.unboundedPreceding, 0))
    drawn = drawn.withColumn("_upto", upto).where(F.col("_upto") <= sample_chars // 2).repartition(1).sortWithinPartitions("label", "_order", "text").select("label", "text")

    def hinge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task for the whole sample, whose size is bounded; the driver gets the weights alone."""
        y, pairs = [], []
        for b in batches:
            for lo, some in groups(b.column("text").to_pylist()):
                o, k = indicators(some)
                pairs.append(((len(y) + lo + o).astype(np.int32), k.astype(np.int32)))
            y += b.column("label").to_pylist()
        y = np.where(np.array(y) == 1, 1.0, -1.0)
        if len(set(y)) == 2:
            owner, bucket = (np.concatenate(x) for x in zip(*pairs, strict=True))
            w, bias = hinge_fit(owner, bucket, ratio, y, c, rounds, seed)
            weights = (w * ratio).astype(np.float32)
            slope, offset = curve(margins(owner, bucket, len(y), weights, ratio, bias), y)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), *[pa.array([float(x)]) for x in (bias, slope, offset)]], ["weights", "bias", "slope", "offset"])

    fitted = drawn.mapInArrow(hinge, "weights binary, bias double, slope double, offset double").collect()
    if not fitted:
        return UNFITTED
    weights, bias, slope, offset = fitted[0]
    return Model(np.stack([np.frombuffer(weights, np.float32), ratio.astype(np.float32)]), bias, slope, offset)


def margins(owner: np.ndarray, bucket: np.ndarray, n: int, weights: np.ndarray, ratio: np.ndarray, bias: float) -> np.ndarray:
    total = np.bincount(owner, weights[bucket], n)
    norm = np.sqrt(np.bincount(owner, ratio[bucket].astype(np.float64) ** 2, n))
    return total / np.maximum(norm, 1e-12) + bias


def curve(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """slope and offset of a logistic curve through the margins, by Newton steps with a small penalty; slope > 0."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    t, b = (y > 0).astype(float), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-1 * np.eye(2), x.T @ (t - p) - 1e-1 * b)
        b = b + np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, 0 to 1: higher where label 1 is likelier.

    Every row gets one, from its whole text: an empty or null text that of no n-grams. The model has a fixed size (2 MB)
    and goes with the tasks. A column named score is replaced; an empty table gives an empty result.
    """
    weights, ratio = model.weights if model.weights.ndim == 2 else (model.weights, model.weights)
    held = docs.sparkSession.sparkContext.broadcast((weights, ratio, model.bias, model.slope, model.offset))

    @F.pandas_udf("double")
    def of(texts):
        import pandas as pd

        w, r, bias, slope, offset = held.value
        out = []
        for _, some in groups(texts.tolist()):
            owner, bucket = indicators(some)
            out.append(1 / (1 + np.exp(-np.clip(slope * margins(owner, bucket, len(some), w, r, bias) + offset, -30, 30))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("score", of(text_of()))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score threshold or more by a model fitted on labels (doc_id, label)."""
    kept = score(docs.withColumn("_row", F.struct(*docs.columns)), fit(docs, labels)).where(F.col("score") >= threshold)
    return kept.select("_row.*")
