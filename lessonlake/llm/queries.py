"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonlake.llm import align, bpe, decontaminate, html_extract, line_dedup, minhash, ngram_join, pii, quality_gam, quality_rules, spelling, substring_dedup, url_filter
from lessonlake.llm.common import table

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

#: The session's setting that holds the owner's key for surrogates.
PII_KEY = "spark.lessonlake.pii.key"


def pii_key(spark: SparkSession) -> str:
    """The owner's key; a session without one gets a random one, so no surrogate is made with a key that others know."""
    key = spark.conf.get(PII_KEY, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(PII_KEY, key)
    return key


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents")).withColumn("removed", F.concat_ws(",", F.col("removed").cast("array<string>")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), bpe.load_vocabulary())


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).drop("text")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), *align.load_tokenizers())


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), shingle=4)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_bpe, op4_html_extract, op5_url_filter, op6_decontaminate, op7_quality_gam, op8_substring_dedup, op9_minhash, op10_pii, op11_align, op12_ngram_join, op13_spelling)}


SQL: dict[str, str] = {}

SQL["op2_line_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT * FROM (SELECT doc_id, pos, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS w FROM l) WHERE len(w) > 0),
c AS (SELECT w, len(w) AS n, first, row_number() OVER (ORDER BY first) AS id FROM (SELECT w, min((doc_id, pos)) AS first FROM k GROUP BY w)),
t AS (SELECT id, n, unnest(w) AS t FROM c),
ordered AS (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY f, t) AS r FROM t JOIN (SELECT t, count(*) AS f FROM t GROUP BY t) USING (t)),
prefix AS (SELECT * FROM ordered WHERE r <= n - (4 * n + 4) // 5 + 1),
candidates AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.t = b.t AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
near AS (SELECT DISTINCT b FROM candidates JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE 100 * len(list_intersect(x.w, y.w)) >= 80 * (x.n + y.n - len(list_intersect(x.w, y.w)))),
gone AS (SELECT k.doc_id, pos FROM k JOIN c USING (w) WHERE (k.doc_id, pos) <> first OR id IN (SELECT b FROM near)),
lost AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(lines) END AS n_lines, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed FROM d LEFT JOIN lost USING (doc_id)
"""

SQL["op5_url_filter"] = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC) AS k
  FROM h JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.host = h.host AND m.path = h.path AND m.k = 1
"""

SQL["op6_decontaminate"] = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
wins AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM low, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, wins.n FROM wins JOIN grams USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

SQL["op8_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM later),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL["op9_minhash"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

SQL["op12_ngram_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""

SQL["op13_spelling"] = r"""
WITH RECURSIVE table_ AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(range(8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, k) AS c FROM range(256) r(k))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
keyed AS (SELECT doc_id, run, count(*) AS k, hex(encode(doc_id || ':' || run)) AS b FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
summed AS (SELECT run, k, xor(list_reduce(list_transform(range(length(b) // 2), lambda i: CAST('0x' || substr(b, 2 * i + 1, 2) AS BIGINT)), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM keyed, table_),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM summed),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM less),
near AS (SELECT DISTINCT a.word AS a, b.word AS b, b.n AS k FROM d a JOIN d b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.v = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.v = w.word),
best AS (SELECT a, count(*) AS n_near, min((-k, b)) AS f FROM near GROUP BY a),
named AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -f[1] >= 5 * n THEN f[2] END AS form, CASE WHEN -f[1] >= 5 * n THEN -f[1] END AS form_n FROM w LEFT JOIN best ON a = word),
chain AS (SELECT word, word AS cur, 0 AS depth FROM w UNION ALL SELECT chain.word, form, depth + 1 FROM chain JOIN named ON named.word = chain.cur WHERE form IS NOT NULL),
last AS (SELECT word, arg_max(cur, depth) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM named JOIN last USING (word)
"""
