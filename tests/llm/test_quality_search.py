import math
import random

import numpy as np

from tickloom.llm import mih, nbsvm

DIR = "/root/testdata/sf0.01"


def test_indicators_do_not_depend_on_neighbours():
    texts = ["", "a", "The the THE cat.", " x\t\n$$$ $$$ 12a ", "é é é", "b" * 300 + " " + "b" * 300]
    owner, bucket = nbsvm.indicators(texts)
    for i, t in enumerate(texts):
        _, alone = nbsvm.indicators([t])
        assert bucket[owner == i].tolist() == alone.tolist()
    assert len(nbsvm.indicators(["a b a b"])[1]) < len(nbsvm.indicators(["a b c d"])[1])


def test_quality_on_held_out_rows(spark):
    from tickloom.llm import queries

    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = {r.doc_id: r for r in queries.op7_nbsvm_quality(spark, DIR).collect()}
    assert len(got) == docs.count()
    seen = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(g.predicted == q for g, q in seen) / len(seen) > 0.95 and all(0 <= g.score <= 1 for g in got.values())


def test_scores_of_odd_rows(spark):
    train = [(i, ("good words here " if i % 2 else "### bad $$$ ") * (1 + i % 5), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(3, 1), (5, 0), (7, 9), (9, None), (None, 1)], "doc_id long, label int")
    model = nbsvm.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, 0.0), (1, "", 1.0), (None, "good words here", 2.0), (2, "$$$ " * 20000, 3.0)], "doc_id long, text string, score double")
    got = nbsvm.score(odd, model).collect()
    assert len(got) == 4 and got[0].score == got[1].score and got[2].score > 0.5 > got[3].score
    assert nbsvm.score(odd.limit(0), model).count() == 0
    none = nbsvm.fit(docs, labels.limit(0))
    assert {r.score for r in nbsvm.score(odd, none).collect()} == {0.5}
    assert nbsvm.keep_good(docs, labels).columns == docs.columns


MASK = (1 << 64) - 1


def plain_mixed(h):
    h = (h ^ h >> 31) * 0x9E3779B97F4A7C15 & MASK
    return h ^ h >> 29


def plain_kind(b):
    return 6 if b >= 128 else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if chr(b) in ".,;:'\"()?-" else 5


def plain_buckets(text):
    """The buckets of a text's n-grams, word by word."""
    words, shapes = [], []
    for w in text.encode().split():
        word = plain_mixed(sum((b + (32 if 65 <= b <= 90 else 0) + 1) * pow(0x100000001B3, k & 63, 1 << 64) for k, b in enumerate(w)) & MASK)
        has = 0
        for b in w:
            has |= 1 << plain_kind(b)
        same = bool(words) and words[-1] == word
        shapes.append(plain_mixed(has | plain_kind(w[0]) << 8 | min(len(w), 4) << 12 | same << 16 | 1 << 40))
        words.append(word)
    out = set()
    for units, longest, salt in ((words, 2, 1), (shapes, 4, 5)):
        for n in range(1, longest + 1):
            for i in range(len(units) - n + 1):
                gram = units[i]
                for u in units[i + 1 : i + n]:
                    gram = plain_mixed((gram * 0x100000001B3 + u) & MASK)
                out.add(((gram + salt + n) * 0x9E3779B97F4A7C15 & MASK) >> 64 - nbsvm.BITS)
    return out


def test_scores_against_a_plain_version(spark):
    """Log-count ratios of colliding indicators, dual coordinate descent and the final score, in dicts and loops."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    vocabulary = [["good", "words", "Here", "fine,", "x1", "déjà"], ["###", "BAD", "$$$", "9 9", "words", "x1"]]
    train = [(i, " ".join(rng.choice(vocabulary[(i % 3 == 0) ^ (rng.random() < 0.2)]) for _ in range(rng.randint(0, 25))), int(i % 3 != 0)) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    model = nbsvm.fit(docs, spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, label int"))
    place = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("h")).collect()}
    rows = [(plain_buckets(t), 1.0 if y else -1.0) for i, t, y in sorted(train, key=lambda r: (r[2], place[r[0]], r[1]))]
    count = {y: {} for y in (1.0, -1.0)}
    for own, y in rows:
        for b in own:
            count[y][b] = count[y].get(b, 0) + 1
    total = {y: sum(c.values()) + nbsvm.BUCKETS for y, c in count.items()}
    seen = set(count[1.0]) | set(count[-1.0])
    ratio = {b: math.log((count[1.0].get(b, 0) + 1) / total[1.0]) - math.log((count[-1.0].get(b, 0) + 1) / total[-1.0]) for b in seen}
    assert all(math.isclose(model.weights[1][b], r, rel_tol=1e-5, abs_tol=1e-6) for b, r in ratio.items()) and np.count_nonzero(model.weights[1]) <= len(seen)

    def unit(own):
        size = max(math.sqrt(sum(ratio.get(b, 0.0) ** 2 for b in own)), 1e-12)
        return {b: ratio.get(b, 0.0) / size for b in own}

    n, sizes = len(rows), {y: sum(r[1] == y for r in rows) for y in (1.0, -1.0)}
    x = [unit(own) for own, _ in rows]
    w, bias, alpha, order = {}, 0.0, [0.0] * n, np.random.default_rng(7)
    for _ in range(30):
        most = 0.0
        for i in order.permutation(n):
            y = rows[i][1]
            slack = y * (sum(w.get(b, 0.0) * v for b, v in x[i].items()) + bias) - 1
            new = min(max(alpha[i] - slack / (sum(v * v for v in x[i].values()) + 1), 0.0), n / (2 * sizes[y]))
            step = (new - alpha[i]) * y
            for b, v in x[i].items():
                w[b] = w.get(b, 0.0) + step * v
            bias, alpha[i], most = bias + step, new, max(most, abs(step))
        if most < 1e-3:
            break
    margin = lambda own: sum(w.get(b, 0.0) * v for b, v in unit(own).items()) + bias
    odd = [(1000, "good new words"), (1001, "### $$$"), (1002, ""), (1003, "unknown"), *[(i, t) for i, t, _ in train[:40]]]
    got = {r.doc_id: r.score for r in nbsvm.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert all(abs(got[i] - 1 / (1 + math.exp(-(model.slope * margin(plain_buckets(t)) + model.offset)))) < 2e-3 for i, t in odd)
    slope, offset = nbsvm.curve(np.array([margin(own) for own, _ in rows]), np.array([y for _, y in rows]))
    assert math.isclose(slope, model.slope, rel_tol=1e-2) and abs(offset - model.offset) < 2e-2


def test_rows_that_repeat_a_doc_id(spark):
    """Repeated rows count as often as they occur; labels that disagree don't count; every row is scored."""
    docs = spark.createDataFrame([(i % 20, "fine words" if i % 2 else "$$ ##") for i in range(40)] + [(99, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 1), (4, 1)], "doc_id long, label int")
    got = nbsvm.score(docs, nbsvm.fit(docs, labels)).collect()
    assert len(got) == 41 and all((r.score > 0.5) == ("fine" in r.text) for r in got)


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, np.array(v, float))
    out = {}
    for i in ok:
        if i % 50 == 0:
            near = sorted((-(ok[i] @ w) / (np.linalg.norm(ok[i]) * np.linalg.norm(w)), j) for j, w in ok.items() if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_search_against_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    rng = random.Random(5)
    dims = len(rows[0][1])
    twin = rows[0][1]
    rows += [(1000 + i, twin) for i in range(40)]
    rows += [(2000, None), (2050, [0.0] * dims), (2100, [float("nan")] * dims), (2150, [None] * dims), (None, twin), (2001, [rng.random() for _ in range(dims)])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in mih.search(mih.build(table), "vec_id % 50 = 0").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute([(i, v if v is None or None in v else np.float32(v).tolist()) for i, v in rows], 5)
    assert got.keys() == want.keys()
    hits = sum(len({j for _, j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert [j for _, j, _ in sorted(got[0])] == [1000, 1001, 1002, 1003, 1004]
    assert [j for _, j, _ in sorted(got[1000])] == [0, 1001, 1002, 1003, 1004]
    for q, rows_ in got.items():
        known = dict(want[q])
        assert [r for r, _, _ in sorted(rows_)] == [1, 2, 3, 4, 5]
        assert all(abs(s - known[j]) < 1e-12 for _, j, s in rows_ if j in known)


def test_search_of_few(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1e300]), (1, [1e-300, 1e-300])], "vec_id long, embedding array<double>")
    got = mih.search(mih.build(table), "vec_id % 50 = 0").collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert mih.search(mih.build(table.limit(0)), table).count() == 0


def test_rows_that_repeat_an_id(spark):
    """Only the query's own row is left out; rows of one id are queries and candidates of their own."""
    table = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.1]), (7, [1.0, 0.2])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in mih.search(mih.build(table), "vec_id = 0").collect()]
    assert sorted(got) == [(0, 1, 0), (0, 1, 7), (0, 2, 0), (0, 2, 7)]  # (1, .1) is nearer to (1, .2) than to (1, 0)
    far = [(r.rank, r.vec_id) for r in mih.search(mih.build(table), table.where("vec_id = 7")).collect()]
    assert far == [(1, 7), (2, 0), (3, 0)]


def shares(rows, queries, k=5):
    """The learned radius, the shares of rows that the index names and that lie within the radius, and the recall, over some queries."""
    x = mih.unit(np.array(rows, float))
    mean, projection = mih.learn(x, 256)
    packed = mih.codes(x, mean, projection)
    radius = mih.learned_radius(x, packed, 0.985, k, len(x))
    tables, named, within, hit = mih.indexed(packed), [], [], []
    for i in queries:
        found = mih.touched(tables, packed[i], len(x), radius)
        inside = mih.probe(tables, packed[i], packed, radius)
        near = np.bitwise_count(packed ^ packed[i]).sum(1, dtype=int) <= radius
        assert set(np.flatnonzero(near)) == set(inside) and found[inside].all()  # the pigeonhole loses nothing
        cos = x @ x[i]
        cos[i] = -2
        hit.append(np.isin(np.argsort(-cos)[:k], inside).mean())
        named.append(found.mean())
        within.append(len(inside) / len(x))
    return radius, float(np.mean(named)), float(np.mean(within)), float(np.mean(hit))


def test_the_index_prunes_vectors_with_structure(spark):
    """Vectors in 400 tight groups: the index names few rows. The given vectors have none, and it names nearly all; the
    whole code's distance prunes there."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(400, 64))
    rows = centres[rng.integers(0, 400, 8000)] + 0.05 * rng.normal(size=(8000, 64))
    radius, named, within, recall = shares(rows, range(0, 8000, 160))
    assert radius < 40 and named < 0.3 and within < 0.01 and recall >= 0.95
    given = [list(r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    flat = shares(given, range(0, len(given), 40))
    assert flat[1] > 0.9 and flat[2] < 0.1 and flat[3] >= 0.9


def test_reaches():
    """Codes within the radius have a substring within its table's reach, for every way to share the radius out."""
    for radius in range(0, 12):
        out = mih.reaches(radius, 4)
        assert sum(r + 1 for r in out) == radius + 1  # one bit more than the radius is needed to miss every table


def test_codes_prune(spark):
    """On the given vectors under a tenth of the rows lie within the radius; recall is held above."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = mih.build(rows)
    coded = index.rows.select("code").collect()
    packed = np.array([np.frombuffer(r.code, np.uint8) for r in coded])
    share = np.mean([(np.bitwise_count(packed ^ code).sum(1) <= index.radius).mean() for code in packed[::50]])
    assert share < 0.1, share


def test_hinge_fit_against_brute_force():
    """Dual coordinate descent reaches the optimum that projected gradient steps on the dual find."""
    rng = np.random.default_rng(3)
    n, width = 60, 40
    x = (rng.random((n, width)) < 0.3).astype(float)
    x[:, 0] = 1
    y = np.where(x[:, 1] + x[:, 2] + rng.normal(0, 0.4, n) > 0.8, 1.0, -1.0)
    ratio = rng.normal(1, 0.5, width)
    owner, bucket = np.nonzero(x)
    w, bias = nbsvm.hinge_fit(owner, bucket, ratio, y, 1.0, 3000, 1)
    f = x * ratio
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    f = np.concatenate([f, np.ones((n, 1))], 1)
    upper = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum()))
    primal = lambda v: v @ v / 2 + (upper * np.maximum(1 - y * (f @ v), 0)).sum()
    gram, alpha = (f * y[:, None]) @ (f * y[:, None]).T, np.zeros(n)
    for _ in range(60_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, upper)
    best = primal((alpha * y) @ f)
    assert abs(primal(np.append(w, bias)) - best) < 0.02 * best
