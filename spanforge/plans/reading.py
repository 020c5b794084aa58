"""Queries of readers and of what texts are cut into: dumps, sentences, subwords, names of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import disambiguation, linking, mentions, packing, sampling, subwords, windows
from spanforge.operators import sentences as S
from spanforge.plans import catalogue as C
from spanforge.plans.catalogue import query
from spanforge.session import fresh_path, keep
from spanforge.sources import dump
from spanforge.sources import pages as P

#: Where the public tokenizer files are.
TOKENIZERS = "/opt/tokenizers"

# dumps


def _dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a dump in several bz2 files, read back: an infobox and a picture with nested markup, the links as one paragraph, and the others as they are; each redirect as a page, every tenth page one of meanings."""
    table = C._t(spark, sf_dir, "pages")
    anchors = P.anchors(table).withColumn("title", P.href_title())
    link = F.when(F.col("title") == F.col("text"), F.concat(F.lit("[["), "text", F.lit("]]"))).otherwise(F.concat(F.lit("[["), "title", F.lit("|"), "text", F.lit("]]")))
    listed = anchors.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", link.alias("link")))), lambda x: x["link"]), " and ").alias("listed"))
    lines = F.array_join(F.regexp_extract_all("html", F.lit(r"<p>([^<]*)</p>"), F.lit(1)), "\n\n")
    head = F.concat(F.lit("{{Infobox|site={{url|"), F.coalesce("url", F.lit("")), F.lit("}}|page={{{1}}}}}\n[[File:seen.png|thumb|a [[Nested|picture]] of it]]\n<!-- not seen [[Hidden]] -->"))
    text = F.concat_ws("\n", head, "listed", lines, F.when(F.col("page_id") % 10 == 0, "{{Disambiguation}}"))
    articles = table.join(listed, "page_id", "left").select("page_id", F.lit(0).alias("ns"), F.concat(F.lit("Page "), "page_id").alias("title"), F.lit(None).cast("string").alias("redirect"), text.alias("text"))
    moved = P.redirects(anchors).select(F.abs(F.xxhash64("src")).alias("page_id"), F.lit(0).alias("ns"), F.col("src").alias("title"), F.col("dest").alias("redirect"), F.concat(F.lit("#REDIRECT [["), "dest", F.lit("]]")).alias("text"))
    path = fresh_path(spark, "dump")
    dump.write_dump(articles.unionByName(moved), path, files=4)
    return dump.read_dump(spark, path)


@query(f"""WITH {C._SQL_ANCHORS}, p AS (SELECT page_id, pos, text, title, sum(length(text) + 5) OVER (PARTITION BY page_id ORDER BY pos) - length(text) - 5 AS s FROM links)
SELECT page_id, pos, text, title, CAST(s AS INTEGER) AS start, CAST(s + length(text) AS INTEGER) AS "end" FROM p""")
def dump_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.links(_dump(spark, sf_dir), capital=False).select("page_id", "pos", "text", "title", "start", "end")


@query(rf"""WITH {C._SQL_ANCHORS}, p AS (SELECT page_id, replace(replace(replace(replace(unnest(regexp_extract_all(html, '<p>([^<]*)</p>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM pages), l AS (SELECT page_id, string_agg(text, ' and ' ORDER BY pos) AS t FROM links GROUP BY 1),
n AS (SELECT page_id, unnest(string_split(t, chr(10))) AS t FROM p UNION ALL SELECT * FROM l), c AS (SELECT page_id, count(*) AS n, sum(length(trim(t))) AS chars FROM n WHERE trim(t) <> '' GROUP BY 1),
m AS (SELECT DISTINCT regexp_replace(h, '^/', '') AS src, lower(regexp_replace(regexp_replace(h, '^/', ''), '[.,]+$', '')) AS dest FROM (SELECT unnest(h) AS h FROM a0))
SELECT 'Page ' || page_id AS title, CAST(NULL AS VARCHAR) AS redirect, page_id % 10 = 0 AS disambiguation, coalesce(n, 0) AS paragraphs, CAST(coalesce(chars, 0) AS BIGINT) AS chars FROM pages LEFT JOIN c USING (page_id)
UNION ALL SELECT src, dest, false, 0, 0 FROM m WHERE src <> dest""")
def dump_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _dump(spark, sf_dir).withColumn("redirect", F.coalesce("redirect", dump.redirect_title("text")))
    own = dump.paragraphs(pages.filter("redirect is null")).groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))
    flags = pages.select("page_id", "title", "redirect", dump.is_disambiguation().alias("disambiguation"))
    return flags.join(own, "page_id", "left").select("title", "redirect", "disambiguation", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), F.coalesce("chars", F.lit(0)).alias("chars"))


# sentences


_SQL_ABBREVIATIONS = rf"""tk AS (SELECT lang, unnest(regexp_extract_all(lower(text), '{C.WORDS}')) AS t FROM documents),
st AS (SELECT lang, CASE WHEN ends_with(t, '.') THEN substring(t, 1, length(t) - 1) ELSE t END AS word, ends_with(t, '.') AS stop FROM tk),
ct AS (SELECT lang, word, count(*) FILTER (stop) AS n_stop, count(*) FILTER (NOT stop) AS n_plain FROM st WHERE regexp_matches(word, '^\p{{L}}[\p{{L}}.]*$') GROUP BY ALL),
sh AS (SELECT lang, sum(n_stop) / sum(n_stop + n_plain) AS p FROM ct GROUP BY 1),
sc AS (SELECT lang, word, n_stop, n_plain, length(replace(word, '.', '')) AS k, 2 * (n_stop * ln({S.SHARE} / p) + n_plain * ln({1 - S.SHARE} / (1 - p))) AS ratio FROM ct JOIN sh USING (lang) WHERE n_stop > 0),
ab AS (SELECT lang, word, n_stop, n_plain, ratio * exp(-k) * (length(word) - k + 1) * pow(k, -n_plain) AS score FROM sc)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C._t(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "lang", "text")


@query(f"WITH {_SQL_ABBREVIATIONS} SELECT lang, word, n_stop, n_plain, round(score, 6) AS score FROM ab WHERE score >= {S.LEAST_SCORE}")
def learned_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = S.abbreviation_scores(S.word_stops(_texts(spark, sf_dir))).filter(F.col("score") >= S.LEAST_SCORE)
    return scored.withColumn("score", F.round("score", 6))


@query()
def sentences_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return S.sentences(docs, "en", S.abbreviations(docs))


@query()
def sentences_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return S.sentences(docs, S.TRAINED, S.abbreviations(docs))


# names of any length


_SQL_LONG_NAMES = rf"""b0 AS (SELECT regexp_extract_all(text, '{C.WORDS}') AS w FROM benchmark),
names AS (SELECT DISTINCT array_to_string(x, ' ') AS name FROM (SELECT w AS x FROM b0 UNION ALL SELECT w[1:10] FROM b0 UNION ALL SELECT w[-5:] FROM b0) WHERE len(x) > 0),
dx AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(text, '{C.WORDS}'), ' ') || ' ' AS t FROM documents)"""


def _long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole items of the benchmark, their first ten and their last five words."""
    words = C._t(spark, sf_dir, "benchmark").select(F.regexp_extract_all("text", F.lit(C.WORDS), F.lit(0)).alias("w"))
    parts = F.array("w", F.slice("w", 1, 10), F.slice("w", F.greatest(F.lit(1), F.size("w") - 4), 5))
    return words.filter(F.size("w") > 0).select(F.explode(F.transform(parts, lambda x: F.array_join(x, " "))).alias("name")).distinct()


@query(f"WITH {_SQL_LONG_NAMES} SELECT doc_id AS page, name FROM dx, names WHERE contains(t, ' ' || name || ' ')")
def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.occurrences(C._words(spark, sf_dir).withColumnRenamed("doc_id", "page"), _long_names(spark, sf_dir))


@query()
def long_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.greedy_links(C._words(spark, sf_dir).withColumnRenamed("doc_id", "page"), _long_names(spark, sf_dir))


# choices and orders


@query(f"""WITH RECURSIVE {C._SQL_LINES}, k AS (SELECT name, title, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, title) AS rn FROM orders3 GROUP BY name, title),
c AS (SELECT DISTINCT page, name AS mention, k.title, n AS score, s_nationkey AS topic FROM orders3 JOIN k USING (name) JOIN supplier ON s_name = k.title WHERE rn <= 5),
r AS (SELECT 1 AS round, page, mention, title, topic, score, row_number() OVER (PARTITION BY page ORDER BY share DESC, mention, title) = 1 AS fixed
      FROM (SELECT *, score / sum(score) OVER (PARTITION BY page, mention) AS share FROM c)
  UNION ALL SELECT round, page, mention, title, topic, score, row_number() OVER (PARTITION BY page ORDER BY share DESC, mention, title) = 1
      FROM (SELECT *, score / sum(score) OVER (PARTITION BY page, mention) AS share
            FROM (SELECT round + 1 AS round, page, mention, title, topic, score + CASE WHEN topic = own THEN 2 ELSE 0 END AS score
                  FROM (SELECT *, max(CASE WHEN fixed THEN mention END) OVER (PARTITION BY page) AS gone, max(CASE WHEN fixed THEN topic END) OVER (PARTITION BY page) AS own FROM r) WHERE mention <> gone)))
SELECT page, mention, title, CAST(score AS BIGINT) AS score, round FROM r WHERE fixed""")
def global_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = C._order_links(spark, sf_dir)
    known = mentions.mention_db(links, links.select("page", "name"), top=5).select("name", "title", F.col("link_count").alias("score"))
    topics = C._t(spark, sf_dir, "supplier").select(F.col("s_name").alias("title"), F.col("s_nationkey").alias("topic"))
    # candidates are listed for each name, before the pages meet them
    lists = keep(disambiguation.candidate_lists(disambiguation.with_topics(known, topics), "name"), "known")
    return disambiguation.choices_in_rounds(links.select("page", "name").join(lists, "name").withColumnRenamed("name", "mention"), weight=2)


@query(f"""WITH {C._SQL_SIZES}, q AS (SELECT dataset, pow(size, 0.7) / sum(pow(size, 0.7)) OVER () AS rate FROM z),
g AS (SELECT doc_id, dataset, CAST(floor(-ln(((doc_id * 48271) % 2147483647 + 0.5) / 2147483647) * {sampling.STEPS} / rate) AS BIGINT) AS gap FROM documents JOIN q ON lang = dataset),
t AS (SELECT doc_id, dataset, sum(gap) OVER (PARTITION BY dataset ORDER BY doc_id) AS t FROM g)
SELECT doc_id, dataset, row_number() OVER (ORDER BY t, dataset, doc_id) - 1 AS place FROM t""")
def drawn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C._t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset"))
    chance = (F.pmod(F.col("doc_id") * 48271, F.lit(2147483647)) + 0.5) / 2147483647
    return sampling.drawn_order(rows, packing.mixing_rates(C._sizes(spark, sf_dir)), "doc_id", chance=chance)


@query("SELECT doc_id, lang FROM documents")
def shuffle_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffle_buffer(C._t(spark, sf_dir, "documents").select("doc_id", "lang"), 128, seed=5)


# subwords


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C._t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("sentence", "text"))


@query()
def subword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = subwords.subwords(_lines(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json")
    return rows.select("doc_id", "sentence", F.posexplode("tokens").alias("pos", "t")).select("doc_id", "sentence", "pos", "t.*")


@query()
def subword_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = subwords.subwords(_lines(spark, sf_dir), f"{TOKENIZERS}/piece_bpe_32k.model")
    sizes = F.filter("sizes", lambda n: n > 0)
    return windows.word_spans(rows.select("doc_id", "sentence", sizes.alias("sizes")).filter(F.size("sizes") > 0), 16, 128)


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence, true AS whole, true AS covers FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))")
def subword_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the tokens of each line, by their places, lie one behind the other and cover it, and give back its text."""
    rows = subwords.subwords(_lines(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json")
    joined = F.array_join(F.transform(F.filter("tokens", lambda t: t["piece"].rlike("^[\x21-\x7E]*$")), lambda t: F.substring(F.col("text"), t["start"] + 1, t["end"] - t["start"])), "")
    pieces = F.array_join(F.transform(F.filter("tokens", lambda t: t["piece"].rlike("^[\x21-\x7E]*$")), lambda t: t["piece"]), "")
    ends = F.aggregate("tokens", F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda s, t: F.struct(t["end"].alias("at"), (s["ok"] & (t["start"] <= s["at"]) & (t["end"] >= s["at"])).alias("ok")))
    return rows.select("doc_id", "sentence", (joined == pieces).alias("whole"), (ends["ok"] & (ends["at"] == F.length("text"))).alias("covers"))


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, strip_accents(lower(x[i])) AS plain FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))")
def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", F.col("sentence").alias("line"), T.strip_accents(F.lower("text")).alias("plain"))
