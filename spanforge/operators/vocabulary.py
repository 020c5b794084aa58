"""Entity vocabularies of one language or several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.ordering import in_order

SPECIAL = ("[PAD]", "[UNK]", "[MASK]")


def entity_counts(links: DataFrame) -> DataFrame:
    """(title, count): how often each title is linked to."""
    return links.groupBy("title").agg(F.count("*").alias("count"))


def in_namespace(title: str = "title"):
    """Whether a title is in the image, file or category namespace."""
    head = F.lower(F.split(F.col(title), ":")[0])
    return (F.instr(F.col(title), ":") > 0) & head.isin("image", "file", "category")


def entity_vocab(links: DataFrame, size: int, *, valid: DataFrame | None = None, min_count: int = 0, first: list[str] = ()) -> DataFrame:
    """(id, title, count) of the special entities, the titles ``first`` that are linked to, then the most linked ones, ``size`` in all.

    Ids are given before titles with fewer than ``min_count`` links go, so that they have gaps. Only
    titles in ``valid`` (title) count, categories never. Ties go by title. The ranking is a top-k:
    no task holds more than ``size`` rows of it.
    """
    counts = entity_counts(links).filter(~F.col("title").startswith("Category:"))
    if valid is not None:
        counts = counts.join(valid.select("title").distinct(), "title", "left_semi")
    spark = links.sparkSession
    fixed = spark.createDataFrame([(0, i, t) for i, t in enumerate(SPECIAL)] + [(1, i, t) for i, t in enumerate(dict.fromkeys(first))], "part int, pos int, title string")
    given = fixed.join(counts, "title", "left").filter("part = 0 or count > 0").select("part", F.col("pos").cast("long").alias("pos"), "title", F.when(F.col("part") == 0, 0).otherwise(F.col("count")).alias("count"))
    rest = counts.join(fixed.filter("part = 1").select("title"), "title", "left_anti").orderBy(F.desc("count"), "title").limit(max(0, size - len(SPECIAL)))
    rows = given.unionByName(rest.select(F.lit(2).alias("part"), (-F.col("count")).alias("pos"), "title", "count"))
    ranked = rows.withColumn("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part", "pos", "title")) - 1).filter(F.col("id") < size)
    return ranked.filter((F.col("part") < 2) | (F.col("count") >= min_count)).select("id", "title", "count")


def multilingual_vocab(counts: DataFrame, items: DataFrame, *, size: int | None = None, min_languages: int = 1) -> DataFrame:
    """(id, title, lang, count) of several languages' titles with one id for each item.

    counts (title, lang, count) meet items (title, lang, item); titles without an item are entities
    of their own. Entities with fewer than ``min_languages`` (title, language) pairs go; those with
    count 0 come first, then by count.
    """
    keyed = counts.join(items, ["title", "lang"], "left").withColumn("key", F.coalesce(F.concat(F.lit("q:"), "item"), F.concat(F.lit("t:"), "lang", F.lit(":"), "title")))
    merged = keyed.groupBy("key").agg(F.sum("count").alias("count"), F.collect_set(F.struct("title", "lang")).alias("entities")).filter(F.size("entities") >= min_languages)
    order = [(F.col("count") == 0).desc(), F.desc("count"), F.col("key")]
    if size is not None:
        ranked = merged.orderBy(*order).limit(size).withColumn("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)
    else:
        ranked = in_order(merged, *order, place="id").withColumn("id", F.col("id").cast("int"))
    return ranked.select("id", F.explode("entities").alias("e"), "count").select("id", "e.title", "e.lang", "count")


def entity_ids(rows: DataFrame, vocab: DataFrame, unknown: int | None = None) -> DataFrame:
    """``rows`` (title, lang) with entity_id; null languages are equal. Those not in ``vocab`` get ``unknown``, or go if it is None."""
    known = vocab.select(F.col("title").alias("__t"), F.col("lang").alias("__l"), F.col("id").alias("entity_id"))
    same = (F.col("title") == F.col("__t")) & F.col("lang").eqNullSafe(F.col("__l"))
    if unknown is None:
        return rows.join(known, same).drop("__t", "__l")
    return rows.join(known, same, "left").withColumn("entity_id", F.coalesce("entity_id", F.lit(unknown))).drop("__t", "__l")


def vocab_size(vocab: DataFrame) -> DataFrame:
    """One row: the number of ids, which several titles can share."""
    return vocab.agg(F.count_distinct("id").alias("size"))


def rekey(vocab: DataFrame) -> DataFrame:
    """(id, key): titles with their language in front, special ones once, and [MASK2] behind the last id."""
    special = F.col("title").isin(*SPECIAL)
    keyed = vocab.select("id", F.when(special, F.col("title")).otherwise(F.concat(F.coalesce("lang", F.lit("None")), F.lit(":"), "title")).alias("key")).distinct()
    return keyed.unionByName(vocab.agg((F.max("id") + 1).alias("id")).select("id", F.lit("[MASK2]").alias("key")))


def shared_vocab(parts: list[DataFrame]) -> DataFrame:
    """Vocabularies of several languages as one table."""
    return reduce(DataFrame.unionByName, parts)


def item_titles(items: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """For each (title, lang) of items all titles of the same item: (title, lang, other, other_lang)."""
    other = items.select("item", F.col("title").alias("other"), F.col("lang").alias("other_lang"))
    return items.join(other, "item").select("title", "lang", "other", "other_lang")


def translate_titles(items: DataFrame, source: str, target: str) -> DataFrame:
    """(title, translated) between two languages; of several the least."""
    pairs = item_titles(items).filter((F.col("lang") == source) & (F.col("other_lang") == target))
    return pairs.groupBy("title").agg(F.min("other").alias("translated"))


def pages_in(pages: DataFrame, known: DataFrame, title: str = "title") -> DataFrame:
    """``pages`` whose ``title`` is one of ``known`` (title)."""
    return pages.join(known.select(F.col("title").alias(title)).distinct(), title, "left_semi").select(*[f"`{c}`" for c in pages.columns])


def abstracts(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs (abstract) that are of a page's abstract."""
    return paragraphs.filter(F.coalesce("abstract", F.lit(False)))


def ids_of_title(vocab: DataFrame, title: str) -> DataFrame:
    """(id, lang) of a title in all languages that have it."""
    return vocab.filter(F.col("title") == title).select("id", "lang")


def titles_of_ids(rows: DataFrame, vocab: DataFrame, lang: str) -> DataFrame:
    """``rows`` (id) with title, the least that the id has in one language; null if it has none."""
    known = vocab.filter(F.col("lang") == lang).groupBy("id").agg(F.min("title").alias("title"))
    return rows.join(known, "id", "left")
