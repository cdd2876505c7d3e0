import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.llm import exact_dedup, filter_audit, periodic
from tickloom.llm.queries import SQL_OP11, SQL_OP13, planted_period

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """rows of (doc_id, text, source), with columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("row", "key", "body", "n", "first", "part", "fails", "runs", "collapsed", "good", "lo")})


# --- exact duplicates -------------------------------------------------------------------------------------------------
ROWS = [(5, "a b", "s"), (3, "ab", "s"), (9, "a  b", None), (1, "a\tb\n", "s"), (7, "", "s"), (2, None, "s"), (4, " \r\n\x0b\x0c", "t"), (8, "ab\u00a0", "s"), (6, "Ab", "s"), (None, "a  b", "s"), (11, "long " * 30000, "s"), (10, "long" * 30000, "s")]


def expected_duplicates(rows):
    texts = {}
    for i, t, _ in rows:
        t = t or ""
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i or 0, i))
    out = []
    for body, own in texts.items():
        first = min(own)
        kept = False
        for r in sorted(own):
            out.append((r[3], first[3], len(own), not kept, hashlib.sha256(body.encode()).hexdigest()))
            kept = True
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, weak):
    """Also under a hash of four bits, where only the comparison of bytes keeps texts apart."""
    texts = [f"t {i % 40}" + " " * (i % 3) for i in range(300)]
    rows = ROWS + [(100 + i, t, "s") for i, t in enumerate(texts)]
    weak_hash = lambda body: F.unhex(F.concat(F.lit("0"), F.substring(F.md5(body), 1, 1)))
    got = exact_dedup.exact_duplicates(frame(spark, rows), content_hash=weak_hash if weak else exact_dedup.md5_bytes)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected_duplicates(rows)


def test_repeated_rows_keep_one(spark):
    got = exact_dedup.exact_duplicates(frame(spark, [(1, "x", "s"), (1, "x", "s"), (1, "x", "s"), (2, "y", "s")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True), (2, 2, 1, True)]
    assert exact_dedup.exact_duplicates(frame(spark, ROWS[:0])).count() == 0


def test_keep_one(spark):
    kept = exact_dedup.keep_one(frame(spark, ROWS[:9]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 8] and "lang" in kept.columns  # 8 has a no-break space


def duck(sql, **tables):
    con = duckdb.connect()
    for name, frame_ in tables.items():
        con.register(name, frame_)
    return con.sql(sql).df()


def test_exact_sql_agrees_on_odd_texts(spark):
    rows = [r for r in ROWS if r[0] is not None]
    want = duck(SQL_OP11, documents=pd.DataFrame([(i, t) for i, t, _ in rows], columns=["doc_id", "text"]))
    got = exact_dedup.exact_duplicates(frame(spark, rows)).toPandas()
    assert sorted(want[got.columns].itertuples(index=False, name=None)) == sorted(got.itertuples(index=False, name=None))


# --- periodic runs ----------------------------------------------------------------------------------------------------
def brute_runs(words, times=4, least=6):
    """Every maximal stretch of every period, the smallest period taken by trying all."""
    n, out = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q):
                own = words[i : i + length]
                if all(any(own[k] != own[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(text):
    words = WORD.findall(text or "")
    runs = brute_runs(words)
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, sha("".join(f"{s},{l},{q}\n" for s, l, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_texts():
    rng = random.Random(5)
    texts = ["", None, " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "a b c " * 4, ("a b " * 4 + "c ") * 4, "x " * 500, "a b a b a b a b c a b a b a b a b", "  " * 7]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            block = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
            parts += block * rng.randint(1, 9) + block[: rng.randint(0, len(block))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    rare = [f"w{i}" for i in range(130)]
    texts.append(" ".join(["pre"] + rare * 4 + rare[:50] + ["post"]))  # beyond the lags whose places are all compared
    texts.append(" ".join(rare * 3 + rare[:129]))  # one word short of four times
    return texts


@pytest.mark.parametrize("lags", [periodic.LAGS, 2, 7])
def test_periodic_runs(spark, lags):
    """Against brute force, with a text's lags in one range and in many."""
    texts = periodic_texts()
    got = periodic.digests(periodic.periodic_runs(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), lags)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: brute_digest(t) for i, t in enumerate(texts)}


def test_lag_test_loses_nothing():
    """Lags that the test of multiples leaves out have no run."""
    rng = random.Random(9)
    for _ in range(200):
        words = [rng.choice("ab").encode() for _ in range(rng.randint(4, 60))]
        ids = periodic.word_ids(words)
        possible = set(periodic.possible_lags(ids, 2, len(ids) // 4 + 1).tolist())
        assert {q for _, _, q in brute_runs(words) if q > 1} <= possible


def test_periodic_odd_rows(spark):
    rows = [(None, "a " * 9, "s"), (1, "b " * 8, "s"), (1, "b " * 8, "s"), (2, "c d " * 60000, "s")]
    got = sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period) for r in periodic.digests(periodic.periodic_runs(frame(spark, rows))).collect()), key=str)
    assert got == [(1, 1, 0, 8, 1), (1, 1, 0, 8, 1), (2, 1, 0, 120000, 2), (None, 1, 0, 9, 1)]
    assert periodic.periodic_runs(frame(spark, rows[:0])).count() == 0
    assert periodic.periodic_runs(frame(spark, rows[1:2])).first().collapsed == "b"


def test_planted_period(spark):
    rows = [(i, None if i % 50 == 3 else " \n".join(f"w{j}" for j in range(i % 37)), "s") for i in range(400)] + [(None, "x  y", "s")]
    got = {r.doc_id: r.text for r in planted_period(frame(spark, rows).select("doc_id", "text")).collect()}
    changed = 0
    for i, text, _ in rows:
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        words, g = (text or "").split(), h // 10
        if h % 10 == 0 and words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            assert got[i] == " ".join(w if j < a else words[a + (j - a) % p] for j, w in enumerate(words))
            changed += 1
        else:
            assert got[i] == (text or "")
    assert changed > 20


# --- filter audit -----------------------------------------------------------------------------------------------------
def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, s in docs:
        t = t or ""
        words = WORD.findall(t)
        fails = {x for x, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i), strict=True) if bad}
        rows.append((s or "", fails, i in good, i in toxic))
    out, removed_by = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            alive = [r for r in rows if r[0] == part]
            all_ = alive
            for step, x in enumerate(order, 1):
                gone = [r for r in alive if x in r[1]]
                alive = [r for r in alive if x not in r[1]]
                fails = [r for r in all_ if x in r[1]]
                out[part, order, step] = (len(alive), len(gone), len(fails) - len(gone), sum(r[1] == {x} for r in fails), sum(r[2] for r in gone), sum(r[3] for r in gone))
                removed_by[part, x] = removed_by.get((part, x), 0) + len(gone)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    rng = random.Random(3)
    docs = []
    for i in range(150):
        words = [rng.choice(["Ab", "cd", "ef$", "gh", "ij", "kl"][: rng.randint(1, 6)]) + (str(rng.randint(0, 999)) if rng.random() < 0.7 else "") for _ in range(rng.randint(0, 400))]
        docs.append((i, " ".join(words), rng.choice(["s", "t", None, "", "only"])))
    docs += [(200 + i, docs[rng.randrange(60)][1], rng.choice("st")) for i in range(60)] + [(300, None, "s"), (301, "", "s"), (None, docs[3][1], "s"), (5, docs[5][1], "t"), (302, "A" * 50000, "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit(spark, monkeypatch):
    docs, labels = audit_rows()
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(docs, labels)
    got = filter_audit.audit(frame(spark, docs).repartition(5), marked).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(filter_audit, "ROWS", 7)  # many chunks, counts sent on early
    monkeypatch.setattr(filter_audit, "PARTS", 1)
    flagged = filter_audit.flags(frame(spark, docs), marked).toPandas()
    import pyarrow as pa

    pieces = [b.to_pandas() for b in filter_audit._count(iter(pa.RecordBatch.from_pandas(flagged.iloc[i : i + 4], preserve_index=False) for i in range(0, len(flagged), 4)))]
    counts = spark.createDataFrame(pd.concat(pieces), filter_audit.COUNTS).groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])
    assert {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.interactions(counts).collect()} == want
    assert filter_audit.audit(frame(spark, docs[:0]), marked.limit(0)).count() == 0


def test_audit_sql_agrees(spark):
    docs, labels = audit_rows()
    docs = [d for d in docs if d[0] is not None]
    want = duck(SQL_OP13, documents=pd.DataFrame([(i, t, s) for i, t, s in docs], columns=["doc_id", "text", "source"]), labels=pd.DataFrame([x for x in labels if x[0] is not None], columns=["doc_id", "quality", "toxic"]))
    got = brute_audit(docs, labels)
    assert {r[:3]: r[3:] for r in want[["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]].itertuples(index=False, name=None)} == got


def test_bits():
    """Packed counts against plain ones, with parts that begin and end within a word."""
    import numpy as np

    rng = np.random.default_rng(0)
    n = 1000
    part, fails, good, toxic = rng.choice(["a", "b", "c", "dd"], n, p=[0.6, 0.3, 0.09, 0.01]), rng.integers(0, 32, n), rng.integers(0, 2, n), rng.integers(0, 2, n)
    names, counts = filter_audit.index_counts(part, fails, good, toxic)
    for i, name in enumerate(names):
        for s in range(32):
            left = (part == name) & (fails & s == 0)
            assert counts[i, s].tolist() == [left.sum(), (left & (good == 1)).sum(), (left & (toxic == 1)).sum()]
