import math
import re
from collections import Counter, defaultdict

import pytest

from tickloom.llm import mixing, url_reputation
from tickloom.llm.queries import RULES


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.ORG/es/x?y#z", "x://example.org/en/12", "nothing", None, "", "://b.com/de/", "a://http://c", "http://u@h.co.uk:80./p", "http://org", "http://org/", "h://example.com/fr/#", "h://notexample.org", "h://1.2.3.4/de/"]
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)] + [(0, urls[0], "old", 1)], "page_id long, url string, host string, suffix int")
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (3, None), (4, 7), (99, 1)], "page_id long, good int")
    got = url_reputation.judge_urls(pages, outcomes, RULES).collect()
    assert len(got) == len(urls) + 1
    by = {r.page_id: r for r in got}
    want = [("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("", "", None), ("", "", None), ("", "", None), ("b.com", "/de/", "com/de/"), ("http:", "//c", None), ("u@h.co.uk:80.", "/p", None), ("org", "", None), ("org", "/", "org/"), ("example.com", "/fr/", "com/fr/"), ("notexample.org", "", None), ("1.2.3.4", "/de/", None)]
    assert [(by[i].host, by[i].path, by[i].rule) for i in range(len(urls))] == want
    assert by[0].verdict == by[1].verdict == by[5].verdict == "block" and by[9].verdict == by[10].verdict == "allow"
    assert all(r.verdict in ("allow", "block") and r.bound is not None for r in got)
    assert url_reputation.judge_urls(pages.limit(0), outcomes, RULES).count() == 0
    assert url_reputation.judge_urls(pages, outcomes.limit(0)).where("verdict is null or bound is null").count() == 0


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 3 == 0 else 'fine'}.x{i % 5}.net/") for i in range(300)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 300)], "page_id long, good int")
    got = url_reputation.judge_urls(pages, outcomes).collect()
    assert all((r.verdict == "block") == r.host.startswith("bad") for r in got)


def shares(sizes: dict, cap: float) -> dict:
    """Targets by literal resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while free and left > 1e-9:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if target[s] + unit * weight[s] >= cap * sizes[s] - 1e-9}
        if not over:
            for s in free:
                target[s] += unit * weight[s]
            break
        for s in over:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        free -= over
    return target


@pytest.mark.parametrize("skew", [1, 40])
def test_mix_reaches_targets(spark, skew):
    rows = []
    for i in range(900):
        source = None if i % 11 == 0 else f"s{min(i % 7, i % skew)}"
        rows.append((i, " ".join(["w"] * (i * 37 % 200)), source, "x", 3))
    rows += [(900, None, "zero", "x", 3), (None, "a b", "s1", "x", 3), (5, "a\tb\x0bc\x1fd\xa0e", "s2", "x", 3), (5, "a", "s2", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, _rank int").repartition(5)
    got = mixing.mix_sources(docs, keep_text=False).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, size(t)) for d, t, *_ in rows)
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        longest[r.source] = max(longest[r.source], r.size)
        assert 0 <= r.copies <= 3
    want = shares(sizes, 3.0)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6) and r.source_size == sizes[r.source]
    for s in want:
        assert abs(taken[s] - want[s]) <= 6 * longest[s] + 1
    again = mixing.mix_sources(docs.repartition(2), keep_text=True)
    assert Counter((r.doc_id, r.size, r.copies) for r in again.collect()) == Counter((r.doc_id, r.size, r.copies) for r in got)
    out = mixing.emit(again)
    assert out.count() == sum(r.copies for r in got) and "text" in out.columns
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_suffixes_of_two_labels(spark):
    hosts = ["a.b.co.in", "x.com.mx", "u.edu.au", "www.example.com", "co.uk", "a.me.com", "1.2.3.4", ""]
    df = url_reputation.with_levels(spark.createDataFrame([(h,) for h in hosts], "host string"))
    got = {r.host: (r.suffix, r.domain) for r in df.collect()}
    want = [("co.in", "b.co.in"), ("com.mx", "x.com.mx"), ("edu.au", "u.edu.au"), ("com", "example.com"), ("co.uk", "co.uk"), ("com", "me.com"), ("1.2.3.4", "1.2.3.4"), ("", "")]
    assert got == dict(zip(hosts, want, strict=True))
