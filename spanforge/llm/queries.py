"""The queries opN_<name>: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import licenses, pieces
from spanforge.llm.alignment import align_tokens
from spanforge.llm.collocations import collocations
from spanforge.llm.common import table
from spanforge.llm.lm import score_texts
from spanforge.llm.mixing import mix
from spanforge.llm.neighbours import nearest
from spanforge.llm.ngram_join import jaccard_join
from spanforge.llm.pii import find_pii
from spanforge.llm.quality import quality
from spanforge.llm.substrings import dedup_substrings
from spanforge.llm.token_counts import edit_counts
from spanforge.llm.warc import round_trip


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op5_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op10_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))


OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
l AS (SELECT payload_digest, max(page_id) AS leader FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN leader IS DISTINCT FROM page_id AND leader IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN leader IS DISTINCT FROM page_id THEN leader END AS refers_to
FROM d LEFT JOIN l USING (payload_digest)
"""


OP11 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 49)) AS p, ws FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, p, md5(array_to_string(ws[p : p + 49], ' ')) AS edge FROM s),
r AS (SELECT doc_id, p FROM k JOIN (SELECT edge, min(doc_id) AS source FROM k GROUP BY edge) USING (edge) WHERE source < doc_id),
u AS (SELECT doc_id, ws, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w WHERE len(ws) > 0),
c AS (SELECT u.doc_id, u.p, u.word, max(r.p) OVER (PARTITION BY u.doc_id ORDER BY u.p ROWS 49 PRECEDING) AS covered FROM u LEFT JOIN (SELECT DISTINCT * FROM r) r ON r.doc_id = u.doc_id AND r.p = u.p),
o AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(count(covered) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (covered IS NULL), '') AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o USING (doc_id)
"""


OP12 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
i AS (SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
w AS (SELECT lang, id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM i),
o AS (SELECT lang, w, w || ' ' || lead(w) OVER q AS w2, w || ' ' || lead(w) OVER q || ' ' || lead(w, 2) OVER q AS w3, w || ' ' || lead(w) OVER q || ' ' || lead(w, 2) OVER q || ' ' || lead(w, 3) OVER q AS w4 FROM w WINDOW q AS (PARTITION BY id ORDER BY i)),
f AS (SELECT lang, 1 AS m, w AS phrase, count(*) AS a FROM o GROUP BY ALL UNION ALL SELECT lang, 2, w2, count(*) FROM o WHERE w2 IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, 3, w3, count(*) FROM o WHERE w3 IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, 4, w4, count(*) FROM o WHERE w4 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 30),
k AS (SELECT lang, phrase, m, a, k, array_to_string(ws[1 : k], ' ') AS p1, array_to_string(ws[k + 1 : m], ' ') AS p2 FROM c, (VALUES (1), (2), (3)) v(k) WHERE k < m),
s AS (SELECT k.lang, k.phrase, k.a, k.k, f1.a AS l, f2.a AS r, (CAST(2000000 AS HUGEINT) * k.a) // (f1.a + f2.a) AS score
      FROM k JOIN f f1 ON f1.lang = k.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = k.lang AND f2.phrase = p2),
x AS (SELECT lang, array_to_string(ws[i : i + j - 1], ' ') AS phrase, max(a) AS most FROM c, (VALUES (1), (2), (3)) u(i), (VALUES (2), (3)) v(j) WHERE j < m AND i + j - 1 <= m GROUP BY 1, 2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b LEFT JOIN x USING (lang, phrase) JOIN n USING (lang) WHERE most IS NULL OR 100 * most < 80 * a
QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle(), "op6_warc": OP6, "op11_substring_dedup": OP11, "op12_collocations": OP12}
