"""The queries op1 to op10, each over its whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunks, decontam, embeddings, jaccard, langid, licenses, packing, quality, quotes, secretscan
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"), secretscan.fit())


def op4_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def embedding_classes_040(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 at a threshold that even the smallest tables have links at."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.4)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_quality, op3_secrets, op4_conversations, op5_decontamination, op6_substring_dedup, op7_packing, op8_embedding_dedup, op9_jaccard_join, op10_licenses, embedding_classes_040)}

_WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP4 = r"""
WITH RECURSIVE placed AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), raw AS (
  SELECT conv_id, pos, unnest(regexp_split_to_array(text, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS k FROM placed
), lines AS (
  SELECT conv_id, pos, k, line, length(replace(replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), ' ', ''), chr(9), '')) AS depth,
    regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '') AS body
  FROM raw
), marked AS (
  SELECT *, coalesce(lag(depth) OVER w, 0) AS last_depth, coalesce(lead(depth) OVER w, 0) AS next_depth FROM lines WINDOW w AS (PARTITION BY conv_id, pos ORDER BY k)
), own AS (
  SELECT conv_id, pos, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (WHERE depth = 0 AND NOT (next_depth > 0 AND regexp_matches(body, '(?i)^[ \t]*(on|am|le|el)[ \t].*(wrote|schrieb|écrit|escribió)[ \t]?:[ \t]*$'))), ''), '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') AS said
  FROM marked GROUP BY ALL
), quoted AS (
  SELECT conv_id, pos, k, depth, sum(CASE WHEN depth <> last_depth THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, pos ORDER BY k) AS passage, trim(regexp_replace(lower(body), '[ \t\r\n\f]+', ' ', 'g')) AS unit
  FROM marked WHERE depth > 0
), whole AS (
  SELECT conv_id, pos, passage, min(depth) AS depth, trim(regexp_replace(string_agg(unit, ' ' ORDER BY k), ' +', ' ', 'g')) AS unit FROM quoted GROUP BY ALL
), asks AS (
  SELECT conv_id, pos, passage, depth, unit FROM whole WHERE unit <> '' UNION SELECT conv_id, pos, passage, depth, unit FROM quoted WHERE unit <> ''
), answers AS (
  SELECT DISTINCT conv_id, pos, trim(regexp_replace(lower(u), '[ \t\r\n\f]+', ' ', 'g')) AS unit FROM (SELECT conv_id, pos, unnest(list_append(string_split(said, chr(10)), said)) AS u FROM own)
), links AS (
  SELECT a.conv_id, a.pos, a.passage, a.depth, a.unit, max(b.pos) AS source FROM asks a JOIN answers b ON a.conv_id = b.conv_id AND a.unit = b.unit AND b.pos < a.pos WHERE b.unit <> '' GROUP BY ALL
), votes AS (
  SELECT conv_id, pos, depth, source, sum(length(unit)) AS chars FROM links GROUP BY ALL
), parent AS (
  SELECT conv_id, pos, source FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, pos ORDER BY depth, chars DESC, source DESC) = 1
), tree AS (
  SELECT p.conv_id, p.pos, p.turn, p.role, o.said, coalesce(r.source, p.pos - 1) AS up,
    coalesce((SELECT count(*) FROM whole w WHERE w.conv_id = p.conv_id AND w.pos = p.pos), 0) AS n_quotes,
    coalesce((SELECT count(DISTINCT passage) FROM links l WHERE l.conv_id = p.conv_id AND l.pos = p.pos), 0) AS n_linked
  FROM placed p JOIN own o ON o.conv_id = p.conv_id AND o.pos = p.pos LEFT JOIN parent r ON r.conv_id = p.conv_id AND r.pos = p.pos
), paths AS (
  SELECT conv_id, pos, [pos] AS path FROM tree WHERE up = -1
  UNION ALL SELECT t.conv_id, t.pos, list_append(s.path, t.pos) FROM tree t JOIN paths s ON s.conv_id = t.conv_id AND s.pos = t.up
)
SELECT t.conv_id, CAST(row_number() OVER (PARTITION BY t.conv_id ORDER BY path) - 1 AS INTEGER) AS reply_rank, t.turn, t.role, t.said AS text, u.turn AS parent_turn,
  CAST(len(path) - 1 AS INTEGER) AS depth, CAST(t.n_quotes AS INTEGER) AS n_quotes, CAST(t.n_linked AS INTEGER) AS n_linked
FROM tree t JOIN paths s ON s.conv_id = t.conv_id AND s.pos = t.pos LEFT JOIN tree u ON u.conv_id = t.conv_id AND u.pos = t.up
"""

_OP5 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT doc_id, len(w) AS n, unnest(generate_series(1, len(w) - 2)) AS p, w FROM d),
dgrams AS (SELECT doc_id, n, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g, strlen(w[p]) + strlen(w[p + 1]) + strlen(w[p + 2]) AS weight FROM dg),
ig AS (SELECT item_id, len(w) AS n, unnest(generate_series(1, len(w) - 2)) AS p, w FROM i),
igrams AS (SELECT item_id, n, g, any_value(weight) AS weight, count(*) AS tf FROM (SELECT item_id, n, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g, strlen(w[p]) + strlen(w[p + 1]) + strlen(w[p + 2]) AS weight FROM ig) GROUP BY item_id, n, g),
totals AS (SELECT item_id, sum(weight * tf) AS total FROM igrams GROUP BY item_id),
run AS (SELECT doc_id, p, sum(weight) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM dgrams),
hits AS (SELECT doc_id, item_id, g, p, igrams.n AS size, dgrams.n AS n, igrams.weight, tf FROM dgrams JOIN igrams USING (g)),
wins AS (SELECT doc_id, item_id, size, n, g, weight, tf, unnest(generate_series(greatest(1, least(p - size + 3, greatest(n - size + 1, 1))), greatest(1, least(p, n - size + 1)))) AS s FROM hits),
counted AS (SELECT doc_id, item_id, size, n, s, sum(weight * least(tf, own)) AS shared FROM (SELECT doc_id, item_id, size, n, s, g, weight, tf, count(*) AS own FROM wins GROUP BY ALL) GROUP BY ALL),
scored AS (SELECT c.doc_id, c.item_id, s - 1 AS first_word, least(size, n) AS n_words, shared / (total + e.upto - coalesce(b.upto, 0) - shared) AS similarity
  FROM counted c JOIN totals USING (item_id) JOIN run e ON e.doc_id = c.doc_id AND e.p = least(s + size - 3, n - 2) LEFT JOIN run b ON b.doc_id = c.doc_id AND b.p = s - 1
  WHERE shared >= 0.5 * total)
SELECT doc_id, item_id, CAST(first_word AS INTEGER) AS first_word, CAST(n_words AS INTEGER) AS n_words, round(similarity, 6) AS similarity FROM scored WHERE similarity >= 0.6
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first_word) = 1
"""

def _op8(threshold: float) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL),
links AS (SELECT a.r, b.r AS s FROM v a JOIN v b ON a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
reach AS (SELECT r, s FROM links UNION SELECT x.r, y.s FROM reach x JOIN links y ON x.s = y.r),
roots AS (SELECT r, min(s) AS root FROM reach GROUP BY r)
SELECT v.vec_id, coalesce(w.vec_id, v.vec_id) AS class_id, (SELECT count(*) FROM links WHERE links.r = v.r) AS n_links FROM v LEFT JOIN roots USING (r) LEFT JOIN v w ON w.r = roots.root
"""


_OP9 = rf"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)),
members AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]) END)) AS g, len(w) = 0 AS bare FROM w),
sets AS (SELECT row_number() OVER (ORDER BY min(doc_id), g) AS s, min(doc_id) AS least, g, count(*) AS copies FROM members WHERE NOT bare GROUP BY g),
flat AS (SELECT s, copies, len(g) AS n, unnest(g) AS gram FROM sets),
met AS (SELECT a.s AS s, b.s AS t, any_value(a.n) AS n_s, any_value(b.n) AS n_t, any_value(b.copies) AS copies, count(*) AS shared FROM flat a JOIN flat b ON a.gram = b.gram AND a.s <> b.s GROUP BY a.s, b.s),
links AS (SELECT s, t, copies FROM met WHERE shared >= 0.5 * (n_s + n_t - shared)),
reach AS (SELECT s, t FROM links UNION SELECT r.s, l.t FROM reach r JOIN links l ON r.t = l.s),
roots AS (SELECT s, min(t) AS root FROM reach GROUP BY s),
told AS (SELECT g, s, coalesce((SELECT least FROM sets x WHERE x.s = least(root, y.s)), least) AS class_id, copies - 1 + coalesce((SELECT sum(copies) FROM links WHERE links.s = y.s), 0) AS n_links FROM sets y LEFT JOIN roots USING (s))
SELECT doc_id, CAST(coalesce(class_id, doc_id) AS BIGINT) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM members m LEFT JOIN told ON told.g = m.g AND NOT m.bare
"""


def _op10() -> str:
    words, rows, classes = _WORDS.replace("text", "template"), [], licenses.index(licenses.TEMPLATES, licenses.N, licenses.THRESHOLD, licenses.RECALL)
    family = licenses.families(classes, licenses.THRESHOLD)
    for number, (license, text) in enumerate(licenses.TEMPLATES):
        rows.append(f"({number}, '{license}', '{family[license]}', '{text}')")
    return rf"""
WITH t AS (SELECT id, license, family, {words} AS w FROM (VALUES {", ".join(rows)}) AS x(id, license, family, template)),
tg AS (SELECT DISTINCT id, license, family, size, g FROM (SELECT id, license, family, CAST(pow(2, ceil(log2(2 * len(w)))) AS BIGINT) AS size, unnest(list_transform(generate_series(1, len(w) - 1), lambda p: w[p] || ' ' || w[p + 1])) AS g FROM t)),
tn AS (SELECT id, count(*) AS n FROM tg GROUP BY id),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT doc_id, w[p] || ' ' || w[p + 1] AS g, p - 1 AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS p FROM d)),
hits AS (SELECT doc_id, k, id, license, family, size, g FROM dg JOIN tg USING (g)),
wins AS (SELECT doc_id, id, license, family, g, k // (size // 2) * (size // 2) AS s FROM hits
  UNION ALL SELECT doc_id, id, license, family, g, (k // (size // 2) - 1) * (size // 2) FROM hits WHERE k >= size // 2 AND k + 2 <= (k // (size // 2) + 1) * (size // 2)),
scored AS (SELECT doc_id, license, family, s, count(DISTINCT g) / any_value(n) AS c FROM wins JOIN tn USING (id) GROUP BY doc_id, id, license, family, s),
best AS (SELECT * FROM scored WHERE c >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY c DESC, s) = 1)
SELECT doc_id, license, round(c, 6) AS containment, CAST(s AS INTEGER) AS window_word FROM best QUALIFY c = max(c) OVER (PARTITION BY doc_id, family)
"""


ORACLE_SQL: dict[str, str] = {"op4_conversations": _OP4, "op5_decontamination": _OP5, "op8_embedding_dedup": _op8(0.95), "embedding_classes_040": _op8(0.4), "op9_jaccard_join": _OP9, "op10_licenses": _op10()}
