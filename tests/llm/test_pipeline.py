from collections import Counter

import public_tokenizers
import tiktoken

from tickloom.llm import bpe

DIR = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_pii import base
    from tests.llm.test_simhash import brute, components

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or docs.columns == names
        kept.append(docs.toPandas())
    whole = spark.read.parquet(f"{DIR}/documents.parquet").toPandas()
    good, single, clean, mixed, coded = kept
    labels = spark.read.parquet(f"{DIR}/labels.parquet").toPandas()
    wrong = labels[(labels.quality == 1) != labels.doc_id.isin(good.doc_id)]
    assert len(wrong) < 0.05 * len(labels) and set(good.doc_id) <= set(whole.doc_id)
    classes = components(brute(dict(zip(good.doc_id, good.text, strict=True))))
    assert sorted(single.doc_id) == sorted(set(classes.values()))
    texts = dict(zip(single.doc_id, single.text, strict=True))
    for d, t in zip(clean.doc_id, clean.text, strict=True):
        assert (t != texts[d]) == (bool(base(texts[d])) or "[CONTEXT]" in t) and not base(t)
    assert sorted(clean.doc_id) == sorted(single.doc_id) and (clean.n_chars == clean.text.str.len()).all()
    assert max(Counter(mixed.doc_id).values()) <= 3 and set(mixed.doc_id) <= set(clean.doc_id)
    words = clean.assign(n=clean.text.str.split().str.len())
    sizes = words.groupby("source").n.sum()
    taken = mixed.assign(n=mixed.text.str.split().str.len()).groupby("source").n.sum()
    assert abs(taken.sum() / sizes.sum() - 1) < 0.3
    vocabulary = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    want = Counter((d, tuple(own.encode_ordinary(t))) for d, t in zip(mixed.doc_id, mixed.text, strict=True))
    assert Counter((d, tuple(i)) for d, i in zip(coded.doc_id, coded.ids, strict=True)) == want
    assert sorted(corpus_pipeline.run(spark, DIR).toPandas().doc_id) == sorted(coded.doc_id)


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, ties and an empty table."""
    import corpus_pipeline

    rows = [(None, None, None, None, None), (1, "", "en", "web", 0), (1, "", "en", "web", 0), (2, "a@b.c " * 3000, None, "web", 18000), (2, "the end", "en", None, 7), (3, None, "de", "", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    quality, single, private, mixed, coded = (f for _, f in corpus_pipeline.STAGES)
    for stage in (quality, single, private, mixed, coded):
        assert stage(spark, odd.limit(0), DIR).count() == 0
    assert quality(spark, odd, DIR).columns == odd.columns
    assert Counter(r.text for r in single(spark, odd, DIR).select("text").collect())["the end"] == 1
    assert sorted(str(r.text)[:7] for r in private(spark, odd, DIR).collect()) == sorted(["None", "None", "", "", "[EMAIL]", "the end"])
    assert {r.doc_id for r in mixed(spark, odd, DIR).collect()} <= {None, 1, 2, 3}
    got = coded(spark, odd, DIR).collect()
    assert len(got) == len(rows) and sorted(r.n_tokens for r in got)[:4] == [0] * 4
