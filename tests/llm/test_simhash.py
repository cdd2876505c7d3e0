import random

import pytest
import xxhash

from tickloom.llm import simhash


def brute(texts: dict) -> dict:
    prints = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    return prints


def components(prints: dict) -> dict:
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_rows_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 40, 200]))) for i in range(120)}
    for i in range(120, 200):
        base = texts[rng.randrange(120)].split()
        if base:
            base[rng.randrange(len(base))] = "x"
        texts[i] = " ".join(base)
    texts |= {200: None, 201: "", 202: "Ab\tCD", 203: "ab cd", 204: "É é " * 3000}
    prints = brute(texts)
    want = components(prints)
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in texts.items()], "doc_id long, text string, k string, fingerprint int").repartition(3)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (7, "A b c d e"), (None, "q r s t u")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(twice).collect()} == {(None, 7), (7, 7), (None, None)}
    assert sorted(r.text for r in simhash.keep_one(twice).collect()) == ["A b c d e", "q r s t u"]


@pytest.mark.parametrize("most", [2, 48])
def test_links_of_dense_clusters(spark, most, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_IN_BUCKET", most)
    rng = random.Random(most)
    seen = set()
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(40):
            seen.add(at)
            for _ in range(rng.choice([1, 2, 3])):
                at ^= 1 << rng.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in seen]
    from tickloom.llm.components import connected_components

    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"))
    for a, b in edges.collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = components(dict(zip(signed, [p & (1 << 64) - 1 for p in signed], strict=True)))
    groups = {}
    for p in signed:
        groups.setdefault(want[p], set()).add(p)
    assert all(len({got.get(p, p) for p in g}) == 1 for g in groups.values())
    assert len({got.get(p, p) for p in signed}) == len(groups)
