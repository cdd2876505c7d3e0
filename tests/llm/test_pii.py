import hashlib
import random
import re

from tickloom.llm import pii


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text: str) -> list:
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_against_brute_force(spark):
    rng = random.Random(4)
    bits = ["a", "b.c", "@", ".", "1", "23", "255", "256", "0001", " ", "-", "+", "(", ")", "4111111111111111", "x@y.z", "1.2.3.4", "é", "😀", "\n", "_", "+1 (555) 123-4567", "4111 1111 1111 1111"]
    texts = ["".join(rng.choices(bits, k=rng.choice([3, 10, 40]))) for _ in range(400)]
    texts += [None, "", "a@b.c_d@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "4111-1111 1111-1111 9", "x@y.z " * 700, "1 " * 20000, "1" * 50000, "a" * 50000 + "@b.c" + ".d" * 9000, "+1" + "(" * 30000 + "2 345678901"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.digests(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].spans.split(",context")[0] == joined or (not joined and got[i].spans.startswith("context")), (t or "")[:80]
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == x for x, _, _ in want) for k in pii.KINDS]
    assert pii.digests(docs.limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"some words here mailto: u{i}@x.org and more the end") for i in range(8)]
    rows += [(20, "then mailto: user77-at-home was said"), (21, "the cat1234567 sat"), (22, "of the end 12 the words"), (20, "mailto: user77-at-home")]
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id long, text string, spans int, value string")
    got = [(r.doc_id, r.spans) for r in pii.digests(docs).collect()]
    assert sorted(x for x in got if x[0] >= 20) == [(20, "context:13:27"), (20, "context:8:22"), (21, ""), (22, "")]
    clean = {r.text for r in pii.redact(docs).where("doc_id >= 20").collect()}
    assert clean == {"then mailto: [CONTEXT] was said", "mailto: [CONTEXT]", "the cat1234567 sat", "of the end 12 the words"}
    assert pii.redact(docs).columns == docs.columns


def test_redaction_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "a@b.c x, 4111111111111111"), (1, "😀 1.2.3.4!")], "doc_id long, text string")
    got = sorted(str(r.text) for r in pii.redact(docs).collect())
    assert got == sorted(["None", "[EMAIL] x, [CARD]", "😀 [IP]!"])


def test_instances_make_patterns_of_the_next_round(spark):
    """Only e-mail addresses are seeds; what stands after their label is found in one round, and its other label in a later one."""
    texts = [f"mailto: u{i}@x.org and more" for i in range(8)] + [f"mailto: member-{i}00 wrote" for i in range(4)]
    texts += [f"here login = member-{i}00 came" for i in range(3)] + ["then login = unseen-4711 came", "the number 1234567 was", "the end, the line and the number 7654321 too"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digests(docs).collect()}
    assert [got[i] for i in range(8, 12)] == ["context:8:18"] * 4 and [got[i] for i in range(12, 16)] == ["context:13:23"] * 3 + ["context:13:24"]
    assert got[16] == got[17] == ""
