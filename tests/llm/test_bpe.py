import hashlib
import random

import public_tokenizers
import pyarrow as pa
import tiktoken

from tickloom.llm import bpe

VOCABULARY = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
OWN = tiktoken.Encoding("own", pat_str=VOCABULARY.pattern, mergeable_ranks=VOCABULARY.ranks, special_tokens={})


def test_ids_and_bytes_against_the_library(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["", None, " ", "a", "don't  stop\n\n it's 's'S", "<|endoftext|>", "x" * 700, "🎉é漢字 naïve ﬁ", "\x1c!\x1c \x85 a", "aaa bbb" * 5, " \t\r\n 12 3456 ___ a_b", "É" * 50]
    letters = "etaoinshrdlcumwfgypbvkxjqz" * 3 + "ETé'ß-1 2\n"
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 120))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "the end"), (3, "a"), (3, "again")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(6)
    monkeypatch.setattr(bpe, "CHUNK", 2000)
    for digest in (False, True):
        monkeypatch.setattr(bpe, "HOT_WORDS", 40 if digest else 100000)
        got = bpe.encode(docs, VOCABULARY, digest=digest).collect()
        want = []
        for i, t in rows:
            ids = OWN.encode_ordinary(t or "")
            raw = (t or "").encode()
            if digest:
                want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
            else:
                want.append((i, ids, raw))
        have = [tuple(r) if digest else (r.doc_id, list(r.ids), bytes(r.decoded)) for r in got]
        assert sorted(map(repr, have)) == sorted(map(repr, want))
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0


def test_words_known_start_anew(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 20)
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    hot = spark.sparkContext.broadcast(bpe.packed(pa.table({"piece": ["word1"]})))
    run = list(bpe.collect_words(VOCABULARY.pattern, VOCABULARY.ranks, hot)(iter(spark.createDataFrame([(i, f"word{i} and more of it") for i in range(5)], "doc_id long, text string").toArrow().to_batches())))
    assert [b.column("fresh")[0].as_py() for b in run] == [True] * 5
