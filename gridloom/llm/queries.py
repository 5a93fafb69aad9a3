"""The registered queries of the subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import collocations, decontam, divergence, jaccard, langid, packing, quality, sharding, substring, tokens, toxicity, urlfilter, warc
from gridloom.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    """The public vocabulary that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), tokenizer_file()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")), "page_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules(spark))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, toxicity.grades(table(spark, sf_dir, "labels"))))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).drop("ids")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_sentencepiece, op4_warc_derivatives, op5_url_filter, op6_toxicity, op7_sharding, op8_quality_rules, op9_substring_dedup, op10_ngram_jaccard, op11_collocations, op12_packing, op13_divergence)}
SQL: dict[str, str] = {}

SQL["op9_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS r(i)
), m AS (
  SELECT g, min(doc_id) AS low FROM s GROUP BY g
), c AS (
  SELECT DISTINCT doc_id, i + j AS p FROM s JOIN m USING (g), unnest(range(13)) AS r(j) WHERE low < doc_id
), a AS (
  SELECT doc_id, list(p) AS gone, count(*) AS n FROM c GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

SQL["op2_decontamination"] = r"""
WITH b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0
), d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM bw) AS l, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n
), m AS (
  SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), h AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, unnest(range(m.n)) AS r(j) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

SQL["op5_url_filter"] = r"""
WITH u AS (
  SELECT page_id,
    coalesce(CASE WHEN contains(url, '://') THEN translate(regexp_extract(regexp_replace(url, '^.*?://', '', 's'), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
    coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(regexp_replace(url, '^.*?://', '', 's'), '^[^/?#]*([^?#]*)', 1, 's') END, '') AS path
  FROM pages
), r(rule, verdict, h, p) AS (
  VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
    ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')
), m AS (
  SELECT host, path, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS v
  FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path
)
SELECT page_id, u.host, u.path, rule, coalesce(v, CASE
  WHEN regexp_matches(u.host || u.path, '^([^/]*[.-])?(spam-[a-z]+|casino(-[a-z]+)?|adult-[a-z]+|ads-track(ing)?|cheap-pills|free-bets|porn|[a-z]*-porn|xxx)[.]|/(.*/)?phishing(/|$)') THEN 'block'
  ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path
"""

SQL["op11_collocations"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT i, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, k, w[j:j + k - 1] AS g FROM w, (VALUES (1), (2), (3)) AS o(k), unnest(range(1, len(w) - k + 2)) AS r(j)
), f AS (
  SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 10
), top AS (
  SELECT lang, g, max(f) AS f FROM (SELECT lang, g[1:2] AS g, f FROM f WHERE k = 3 AND f >= 10 UNION ALL SELECT lang, g[2:3], f FROM f WHERE k = 3 AND f >= 10) GROUP BY lang, g
), kept AS (
  SELECT c.* FROM c LEFT JOIN top ON c.lang = top.lang AND c.g = top.g WHERE top.f IS NULL OR 100 * top.f < 50 * a
), s AS (
  SELECT kept.lang, kept.g, a, cut, x.f AS l, y.f AS r, 1000000 * a::HUGEINT * a::HUGEINT // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM kept JOIN (VALUES (1), (2)) AS o(cut) ON cut < kept.k
  JOIN f AS x ON x.lang = kept.lang AND x.g = kept.g[1:cut] JOIN f AS y ON y.lang = kept.lang AND y.g = kept.g[cut + 1:kept.k]
), low AS (
  SELECT *, array_to_string(g, ' ') AS phrase FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM low JOIN n USING (lang) QUALIFY rank <= 2000
"""

SQL["op13_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT i, lang, source, unnest(list_filter(regexp_split_to_array(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 10
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)
), p AS (
  SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS p
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) JOIN v USING (lang)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""
