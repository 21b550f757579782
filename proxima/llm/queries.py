"""The registered queries of the training-data operators and, where SQL can express one,
its DuckDB equivalent.  Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxima.llm import (centroids, decontam, exact_dedup, html_extract, langid, mixing, quality, sharding, simhash, spelling,
                         toxicity, url_filter, warc)
from proxima.llm.common import table
from proxima.session import scratch_path


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), lambda i: ~quality.held_out(i))
    return quality.classify(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, lambda i: ~langid.held_out(i))
    return langid.identify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), scratch_path(spark, "digest-index"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda i: ~toxicity.held_out(i))
    out = toxicity.tag(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(pages)).select("page_id", "host", "path", "rule", "verdict")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_simhash_near_dedup, op2_quality_classifier, op3_language_id, op4_html_extraction, op5_exact_dedup, op6_mixing,
        op7_decontamination, op8_toxicity, op9_url_filter, op10_sharding, op11_spelling_variants, op12_warc, op13_centroid_clustering)}


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP5 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY digest) AS group_size,
       row_number() OVER w = 1 AS kept,
       digest AS text_sha256
FROM d
WINDOW w AS (PARTITION BY digest ORDER BY points DESC, doc_id NULLS LAST)
"""

_OP7 = f"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
places AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM d, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n),
found AS (
  SELECT p.r, p.i, p.n, g.item FROM places p
  JOIN grams g ON g.n = p.n AND g.gram = array_to_string(list_slice(p.w, p.i, p.i + p.n - 1), ' ')),
hits AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""


#: CRC-32 of a string of letters up to U+00FF: its bytes bit by bit, lowest first, through the polynomial.
_CRC32 = """CAST(xor(list_reduce(list_prepend(4294967295, flatten(list_transform(flatten(list_transform(string_split({}, ''),
  lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)),
  lambda b: list_transform(range(8), lambda i: (b >> i) & 1)))), lambda a, t: xor(a >> 1, (xor(a, t) & 1) * 3988292384)), 4294967295) AS BIGINT)"""

_OP11 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
h AS (SELECT run, {_CRC32.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs WHERE length(run) >= 7),
made AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
less AS MATERIALIZED (SELECT DISTINCT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word AS word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT less.word, w.word FROM less JOIN words w ON less.rest = w.word
  UNION SELECT DISTINCT w.word, less.word FROM less JOIN words w ON less.rest = w.word),
near AS (
  SELECT p.word, count(*) AS n_near, first(p.other ORDER BY w.n DESC, encode(p.other)) AS best, max(w.n) AS best_n
  FROM pairs p JOIN words w ON w.word = p.other GROUP BY p.word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
chain(word, root) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

_OP12 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
r AS (
  SELECT *, strlen(html) >= 100 AND row_number() OVER w > 1 AS again, first_value(page_id) OVER w AS lead
  FROM p WINDOW w AS (PARTITION BY digest ORDER BY page_id NULLS LAST, url NULLS LAST))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN lead END AS refers_to
FROM r
"""


def _op13() -> str:
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = "SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, c.c, {} AS d FROM v, c{} c) GROUP BY r"
    steps = []
    for i in range(centroids.ROUNDS):
        steps.append(f"""a{i} AS MATERIALIZED ({near.format(apart, i)}),
m{i} AS (SELECT c, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
  FROM (SELECT a.c, unnest(v.x) AS x, unnest(range(1, {centroids.DIM + 1})) AS pos FROM a{i} a JOIN v USING (r)) GROUP BY c, pos),
n{i} AS (SELECT c, list(x ORDER BY pos) AS x FROM m{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN n{i} n USING (c))""")
    last = centroids.ROUNDS
    return f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) = {centroids.DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {centroids.DIM}),
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda y: CAST(floor({centroids.SCALE} * y) AS BIGINT)) AS x FROM kept),
s AS (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x FROM v),
c0 AS MATERIALIZED (SELECT c, x FROM s WHERE c < {centroids.CENTROIDS}),
{", ".join(steps)},
z AS MATERIALIZED ({near.format(apart, last)})
SELECT v.vec_id, CAST(z.c AS INTEGER) AS cluster, CAST(z.d AS BIGINT) AS distance, CAST(sum(z.d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(z.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM z JOIN v USING (r) JOIN c{last} c ON c.c = z.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": _OP5, "op7_decontamination": _OP7, "op11_spelling_variants": _OP11, "op12_warc": _OP12, "op13_centroid_clustering": _op13()}
