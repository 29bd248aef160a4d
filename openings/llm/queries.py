"""The registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .block_labeller import main_texts
from .content_sort import exact_groups
from .cotraining import quality_scores
from .cover_tree import top_k
from .decontaminate import find_leaks
from .divergence import source_divergences
from .license_scan import scan_licenses
from .minhash import near_duplicates
from .mixing import mix_sources, taken_words
from .secret_scan import scan_secrets
from .suffix_tree import language_model_scores
from .url_filter import filter_urls
from .vector_codes import ROUNDS, compress


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, threshold_percent=80)


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("found")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix_sources(_table(spark, sf_dir, "documents")))


#: (verdict, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergences(_table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op12_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_table(spark, sf_dir, "embeddings"), scale=1024)


def _codes_sql(rounds: int) -> str:
    """Codebooks round by round, each a CTE; nearest entries by comparing all."""
    out = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        "s AS MATERIALIZED (SELECT vec_id, label, p.part, e[p.part * len(e) // 4 + 1 : (p.part + 1) * len(e) // 4] AS x FROM v, (SELECT unnest([0, 1, 2, 3]) AS part) p)",
        "b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM s WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256))",
    ]
    for i in range(rounds + 1):
        distance = "CAST(list_sum(list_transform(list_zip(s.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        out.append(f"a{i} AS MATERIALIZED (SELECT s.vec_id, s.label, s.part, s.x, min(({distance}, b.entry)) AS m FROM s JOIN b{i} b USING (part) GROUP BY ALL)")
        if i < rounds:
            total = "sum(CAST(x[d] AS HUGEINT))"
            out.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN (
    SELECT part, entry, list(CAST(c AS BIGINT) ORDER BY d) AS c FROM (
      SELECT part, m[2] AS entry, d, ({total} - (({total} % count(*) + count(*)) % count(*))) // count(*) AS c
      FROM a{i}, (SELECT unnest(generate_series(1, (SELECT max(len(x)) FROM s))) AS d) GROUP BY ALL)
    GROUP BY ALL) n USING (part, entry))""")
    out.append(f"r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(m[2] AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM r"""


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_cover_tree": op2_cover_tree,
    "op3_decontaminate": op3_decontaminate,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_license_scan": op5_license_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_main_text": op7_main_text,
    "op8_quality": op8_quality,
    "op9_mix_sources": op9_mix_sources,
    "op10_url_filter": op10_url_filter,
    "op11_source_divergence": op11_source_divergence,
    "op12_content_sort": op12_content_sort,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {
    "op1_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_sort(list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1]))))
                      WHEN len(w) = 1 THEN [hash(w[1])] ELSE [] END AS s
  FROM w),
g AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
pairs AS (
  SELECT a.id AS x, b.id AS y, a.n + b.n AS n, len(list_intersect(a.s, b.s)) AS common
  FROM g a JOIN g b ON a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT x, y FROM pairs WHERE 100 * common >= 80 * (n - common)
  UNION ALL SELECT y, x FROM pairs WHERE 100 * common >= 80 * (n - common)),
reach AS (
  SELECT id AS x, id AS y FROM g
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
root AS (SELECT x AS id, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.component_id, s.doc_id) AS component_id,
       s.doc_id = coalesce(r.component_id, s.doc_id) AS kept
FROM s LEFT JOIN g ON g.s = s.s LEFT JOIN root r ON r.id = g.id
""",
    "op10_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT h.page_id, h.host, h.path,
       (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM r
        WHERE (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)) AS rule,
       coalesce((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM r
        WHERE (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)), 'allow') AS verdict
FROM h
""",
    "op2_cover_tree": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lc FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM k GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (g.n + 2 * l.v) AS HUGEINT) AS p, CAST(1 + (1000000000 * (k.lc + 2)) // (l.ln + 2 * l.v) AS HUGEINT) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
""",
    "op12_content_sort": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
""",
    "op13_vector_codes": _codes_sql(ROUNDS),
}
