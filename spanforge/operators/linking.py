"""Mention candidates of pages, and longest-match linking of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.names import name_runs


def unique_candidates(links: DataFrame, min_probability: float = 0.0) -> DataFrame:
    """(page, name, title) of names that occur in one link of the page only, from links (page, name, title, link_prob)."""
    kept = links.filter(F.col("link_prob") >= min_probability)
    return kept.groupBy("page", "name").agg(F.count("*").alias("n"), F.first("title").alias("title")).filter("n = 1").drop("n")


def agreed_candidates(links: DataFrame, min_probability: float = 0.0) -> DataFrame:
    """(page, name, title) of names, in lower case, that all lead to one title."""
    kept = links.filter(F.col("link_prob") >= min_probability).withColumn("name", F.lower(F.trim("name")))
    return kept.groupBy("page", "name").agg(F.count_distinct("title").alias("n"), F.min("title").alias("title")).filter("n = 1").drop("n")


def translated_candidates(candidates: DataFrame, translations: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates (page, title) in another language: (page, name, title) by translations (title, translated) and names (title, name) of the target; names that two titles of a page share go."""
    moved = candidates.select("page", "title").distinct().join(translations, "title").select("page", F.col("translated").alias("title")).distinct()
    named = moved.join(names.select("title", "name").distinct(), "title")
    return named.groupBy("page", "name").agg(F.count("*").alias("n"), F.min("title").alias("title")).filter("n = 1").drop("n")


def greedy_links(docs: DataFrame, names: DataFrame, longest: int | None = None, subword: str | None = None) -> DataFrame:
    """(page, start, end, name) of docs (page, words): from each word on the longest name (of ``longest`` tokens at most, or of any number) wins, and linking goes on behind it.

    ``subword`` names a column of flags, true for tokens that go on with a word: they are joined
    without a space, and no link starts or ends inside a word.

    Runs of words meet names by two hashes of 64 bits and their length. What overlaps is then settled page by page: hits go by in order, and only
    where the last link ended is remembered.
    """
    hits = name_hits(docs, names, longest, subword)
    kind = dict(docs.dtypes)["page"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, at = object(), 0
        for batch in batches:
            keep = []
            for p, start, end in zip(*[batch.column(c).to_pylist() for c in ("page", "start", "end")], strict=True):
                if p != page:
                    page, at = p, 0
                keep.append(start >= at)
                if start >= at:
                    at = end
            yield batch.filter(pa.array(keep, pa.bool_()))

    # of the names at a word the longest comes first: if it is a link, or overlaps one, so do the shorter ones
    ordered = hits.select("page", "start", "end", "name").repartition("page").sortWithinPartitions("page", "start", F.desc("end"))
    return ordered.mapInArrow(run, f"page {kind}, start int, end int, name string")


def name_hits(docs: DataFrame, names: DataFrame, longest: int | None = None, subword: str | None = None) -> DataFrame:
    """(page, start, end, name) of all runs of words of docs (page, words) that are names, of up to ``longest`` words or of any number.

    With ``subword`` words are put together first, and places are those of the tokens again after that.
    """
    if not subword:
        return name_runs(docs, names, longest).select("page", "start", (F.col("start") + F.col("n")).alias("end"), "name")
    # what goes on with a word before any word has begun belongs to none
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: ~F.element_at(subword, (i + 1).cast("int")))
    begun = docs.filter(F.size("words") > 0).select("page", "words", at.alias("at"))
    ends = F.concat(F.slice("at", 2, 1 << 30), F.array(F.size("words")))
    whole = F.transform(F.arrays_zip(F.col("at").alias("a"), ends.alias("b")), lambda x: F.array_join(F.slice("words", x["a"] + 1, x["b"] - x["a"]), ""))
    joined = begun.filter(F.size("at") > 0).select("page", whole.alias("words"), "at", ends.alias("ends"))
    # the places ride along in the page, so that nothing is joined back
    held = joined.select(F.struct("page", "at", "ends").alias("page"), "words")
    found = name_runs(held, names).select("page.page", F.element_at("page.at", F.col("start") + 1).alias("start"), F.element_at("page.ends", F.col("start") + F.col("n")).alias("end"), "name")
    return found if longest is None else found.filter(F.col("end") - F.col("start") <= longest)
