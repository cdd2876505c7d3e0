"""The queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, exact_dedup, filter_audit, media_avi, mih, mixing, nbsvm, passages, periodic, pii, simhash, token_store, url_reputation
from tickloom.llm.common import WORD, ship, table, text_of
from tickloom.llm.url_reputation import Rule

#: The rules of the query contract.
RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the quality label of its id, where there is one."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = url_reputation.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_labelled")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_store(spark, store, digest=True)


def op4_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.digests(table(spark, sf_dir, "documents"))


def op5_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op6_bpe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary, digest=True)


def op7_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits on labels whose crc32(doc_id) mod 4 isn't 2 and scores every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = nbsvm.held_out(F.col("doc_id"))
    model = nbsvm.fit(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    scored = nbsvm.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, candidates all others."""
    return mih.search(mih.build(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "vec_id % 50 = 0", k=5)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def planted_period(docs: DataFrame) -> DataFrame:
    """docs with the periods of the query contract: in texts whose crc32(doc_id) ends in 0, the words from a on repeat every p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))
    n = F.size("_words")
    staged = docs.withColumn("_g", F.when(h % 10 == 0, g)).withColumn("_words", F.when(F.col("_g").isNotNull(), words))
    staged = staged.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int")).withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    rest = n - F.col("_a")
    block = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    many = F.flatten(F.array_repeat(block, F.ceil(rest / F.col("_p")).cast("int")))
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(many, F.lit(1), rest)), " ")
    return staged.withColumn("text", F.when(F.col("_a").isNotNull(), text).otherwise(text_of())).select(*docs.columns)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(planted_period(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL_OP1 = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\.*$', '') AS name FROM p),
g AS (SELECT *, string_split(name, '.') AS l, regexp_matches(name, '^[0-9.]+$') AS ip FROM h),
t AS (SELECT *, regexp_matches(array_to_string(l[-2:], '.'), '^(ac|co|com|edu|go|gob|gov|gouv|govt|gv|id|info|ltd|me|mil|ne|net|nhs|nic|nom|or|org|plc|sch|web)[.][a-z][a-z]$') AS two FROM g),
d AS (SELECT page_id, host, path, name, CASE WHEN ip THEN name WHEN two THEN array_to_string(l[-2:], '.') ELSE array_to_string(l[-1:], '.') END AS suffix,
    CASE WHEN ip THEN name WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM t),
lab AS (SELECT doc_id, count(*) AS n, sum(quality) AS k FROM labels WHERE quality IN (0, 1) GROUP BY 1),
hosts AS (SELECT suffix, domain, name, coalesce(sum(lab.n), 0)::DOUBLE AS n, coalesce(sum(lab.k), 0)::DOUBLE AS k FROM d LEFT JOIN lab ON lab.doc_id = d.page_id GROUP BY 1, 2, 3),
doms AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2),
sufs AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM doms GROUP BY 1),
s0 AS (SELECT *, (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2.0) FROM sufs)::DOUBLE AS m FROM sufs),
s1 AS (SELECT *, 1 / least(greatest(coalesce((SELECT sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0) FROM s0), 0.001), 0.001), 0.5)::DOUBLE - 1 AS s FROM s0),
d0 AS (SELECT doms.*, (s * m + s1.k) / (s + s1.n) AS m FROM doms JOIN s1 USING (suffix)),
d1 AS (SELECT *, 1 / least(greatest(coalesce((SELECT sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0) FROM d0), 0.001), 0.001), 0.5)::DOUBLE - 1 AS s FROM d0),
h0 AS (SELECT hosts.*, (s * m + d1.k) / (s + d1.n) AS m FROM hosts JOIN d1 USING (suffix, domain)),
h1 AS (SELECT *, 1 / least(greatest(coalesce((SELECT sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0) FROM h0), 0.001), 0.001), 0.5)::DOUBLE - 1 AS s FROM h0),
post AS (SELECT name, n, (s * m + k) / (s + n) AS mean, s FROM h1),
bounds AS (SELECT name, n, mean - 1.645 * sqrt(mean * (1 - mean) / (s + n + 1)) AS bound FROM post),
r(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
fit AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM (SELECT DISTINCT host, path FROM d) AS u
    JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY 1, 2)
SELECT page_id, d.host, d.path, fit.rule, coalesce(fit.verdict, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict, bounds.n::BIGINT AS n_labelled
FROM d JOIN bounds USING (name) LEFT JOIN fit ON fit.host = d.host AND fit.path = d.path
"""

SQL_OP2 = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, key, sum(size)::BIGINT AS source_size, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY 1, 2),
o AS (SELECT *, 3.0::DOUBLE * source_size AS stop, 3.0::DOUBLE * source_size / w AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
    FROM o WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, least(stop, w * coalesce((SELECT level FROM l WHERE ratio >= level ORDER BY ratio, level LIMIT 1), 0)) AS target FROM l),
n AS (SELECT doc_id, size, source_size, target, least(coalesce(target / nullif(source_size, 0), 0), 3.0)::DOUBLE AS rate,
    row_number() OVER (PARTITION BY d.key ORDER BY length(bin(size)), ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || h), 1, 8))::BIGINT % (SELECT greatest(64, ceil(count(*) / 1000000))::BIGINT FROM documents), doc_id NULLS FIRST, size, h) AS i,
    ('0x' || substr(md5(d.key || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d JOIN g USING (key))
SELECT doc_id, size, source_size, target, (least(floor(i * rate + u) - floor((i - 1) * rate + u), 3) * size)::BIGINT AS taken FROM n
"""

SQL_OP11 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
f AS (SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body)::BIGINT AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM f
"""

SQL_OP13 = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (SELECT part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM w LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1) AS l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY 1, 2),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, (SELECT sum(bit) FROM x WHERE strpos(filter_order, letter) < step) AS before FROM o, range(1, 6) AS r(step)),
b AS (SELECT filter_order, step::INT AS step, s.letter, coalesce(before, 0)::INT AS before, bit FROM s JOIN x ON x.letter = s.letter),
q AS (SELECT part, filter_order, step, letter, sum(CASE WHEN fails & (before + bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM b, c GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM q
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = [op1_url_reputation, op2_mix_sources, op3_token_store, op4_avi_media, op5_pii_bootstrap, op6_bpe_fold, op7_nbsvm_quality, op8_simhash_pigeonring, op9_passages, op10_multi_index_hashing, op11_exact_dedup, op12_periodic_runs, op13_filter_audit]
    return {f.__name__: _shipping(f) for f in all_}


def _shipping(f):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    query.__name__, query.__doc__ = f.__name__, f.__doc__
    return query


def oracle_sql() -> dict[str, str]:
    return {"op1_url_reputation": SQL_OP1, "op2_mix_sources": SQL_OP2, "op11_exact_dedup": SQL_OP11, "op13_filter_audit": SQL_OP13}
