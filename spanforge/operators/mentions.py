"""Statistics of mentions: which names stand for which entities, and how often."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.text import normalize_mention
from spanforge.operators.linking import name_hits


def name_entity_counts(links: DataFrame) -> DataFrame:
    """(name, title, link_count) from links (page, name, title)."""
    return links.groupBy("name", "title").agg(F.count("*").alias("link_count"))


def name_pages(rows: DataFrame) -> DataFrame:
    """(name, doc_count): pages that have a name, however often, from rows (page, name)."""
    return rows.select("page", "name").distinct().groupBy("name").agg(F.count("*").alias("doc_count"))


def ngrams(words, n: int):
    """All runs of up to ``n`` words, joined by spaces, from an array column."""
    of = lambda size: F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[of(k) for k in range(1, n + 1)]))


def occurrences(docs: DataFrame, names: DataFrame, longest: int | None = None) -> DataFrame:
    """(page, name) for each page of docs (page, words) and name, of up to ``longest`` words or of any number, that stands in it at word boundaries."""
    return name_hits(docs, names, longest).select("page", "name").distinct()


def mention_db(links: DataFrame, pages: DataFrame, *, top: int = 30, min_links: int = 1, min_probability: float = 0.0) -> DataFrame:
    """(name, title, link_count, total_link_count, doc_count, link_prob, prior_prob) from links (page, name, title) and the names on pages (page, name).

    A name's link probability is the share of its pages with a link, at most 1; names on no page go,
    as do those whose unclipped share is below ``min_probability``. Of a name's titles the ``top``
    most linked stay, ties by title.
    """
    counts = name_entity_counts(links).withColumn("total_link_count", F.sum("link_count").over(Window.partitionBy("name")))
    joined = counts.join(name_pages(pages), "name").filter(F.col("total_link_count") >= F.col("doc_count") * min_probability)
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("link_count"), "title"))
    kept = joined.withColumn("rank", rank).filter((F.col("rank") <= top) & (F.col("link_count") >= min_links)).drop("rank")
    return kept.withColumn("link_prob", F.least(F.lit(1.0), F.col("total_link_count") / F.col("doc_count"))).withColumn("prior_prob", F.least(F.lit(1.0), F.col("link_count") / F.col("total_link_count")))


def entity_db(links: DataFrame, *, top: int = 30, min_count: int = 1) -> DataFrame:
    """(title, name, count): the ``top`` names of each title, ties by name."""
    counts = links.groupBy("title", "name").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("title").orderBy(F.desc("count"), "name"))
    return counts.withColumn("rank", rank).filter((F.col("rank") <= top) & (F.col("count") >= min_count)).drop("rank")


def wiki_link_db(links: DataFrame, mentions: DataFrame) -> DataFrame:
    """(page, name, title, link_prob) of distinct links; a name without statistics has 0.0."""
    known = mentions.groupBy("name").agg(F.max("link_prob").alias("link_prob"))
    return links.select("page", "name", "title").distinct().join(known, "name", "left").select("page", "name", "title", F.coalesce("link_prob", F.lit(0.0)).alias("link_prob"))


def prior_counts(prior: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(name, title, link_count, doc_count) from a prior file's rows (name, total, prob, title): counts are whole parts; doc_count from the name's link probability in ``known`` (name, link_prob), else 0."""
    rows = prior.select("name", "title", (F.col("prob") * F.col("total")).cast("int").alias("link_count"), "total")
    if known is None:
        return rows.select("name", "title", "link_count", F.lit(0).alias("doc_count"))
    one = known.groupBy("name").agg(F.max("link_prob").alias("link_prob"))
    docs = F.coalesce((F.col("total") / F.when(F.col("link_prob") > 0, F.col("link_prob"))).cast("int"), F.lit(0))
    return rows.join(one, "name", "left").select("name", "title", "link_count", docs.alias("doc_count"))


def page_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(page, links): for pages (page) their links (page, name, title, link_prob) in order of name and title; [] for those without."""
    own = links.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("name", "title", "link_prob"))).alias("links"))
    none = F.expr("cast(array() as array<struct<name:string,title:string,link_prob:double>>)")
    return pages.join(own, "page", "left").select("page", F.coalesce("links", none).alias("links"))


def lookup(db: DataFrame, texts: DataFrame) -> DataFrame:
    """(text, found): for texts (text) the rows of a mention table (name in normal form, title, prior_prob) under their normal form, best first; [] for those without."""
    own = db.groupBy("name").agg(F.array_sort(F.collect_list(F.struct((-F.col("prior_prob")).alias("minus"), "title"))).alias("all"))
    keyed = texts.withColumn("name", normalize_mention("text", lower=True)).join(own, "name", "left")
    return keyed.select("text", F.coalesce(F.col("all.title"), F.expr("cast(array() as array<string>)")).alias("found"))


def short_names(db: DataFrame, tokens: str, longest: int) -> DataFrame:
    """The rows of a mention table whose name has up to ``longest`` tokens."""
    return db.filter(F.size(tokens) <= longest)
