"""Whole jobs: candidates for the articles of a question file, in any language, linked entities, and evaluation by file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from spanforge.functions.text import normalize_mention
from spanforge.operators import linking, scores
from spanforge.operators.names import name_runs
from spanforge.session import small_batches
from spanforge.sources import files
from spanforge.sources.pages import resolve


def unique_by(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, as they are; reading them is an error if two have the same ``key``."""
    counted = rows.withColumn("__same", F.count("*").over(Window.partitionBy(key)))
    told = F.when(F.col("__same") > 1, F.raise_error(F.concat(F.lit(f"{key} is there more than once: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return counted.filter(told).drop("__same")


def results_of_examples(results: DataFrame, features: DataFrame, examples: DataFrame) -> DataFrame:
    """results (unique_id, ...) with what features (unique_id, example_index, ...) and examples (example_index, ...) know of them; each id is there once, or it is an error. Features without a result don't come."""
    return unique_by(results, "unique_id").join(unique_by(features, "unique_id"), "unique_id").join(unique_by(examples, "example_index"), "example_index")


def title_candidates(titles: DataFrame, links: DataFrame, *, link_moves: DataFrame | None = None, model_moves: DataFrame | None = None, min_probability: float = 0.01) -> DataFrame:
    """(title, name, entity) for titles (title): the names that links (page: a title, name, title, link_prob) of the article give one entity only.

    ``link_moves`` (src, dest) leads from a title to the one that links know, ``model_moves`` from an
    entity to the one that a vocabulary knows; a source is there once. Names are in normal form. A
    title without an article or candidates has no rows.
    """
    asked = titles.select("title", F.col("title").alias("page")).distinct()
    asked = resolve(asked, "page", link_moves) if link_moves is not None else asked
    own = linking.unique_candidates(links, min_probability).select("page", normalize_mention("name", lower=True).alias("name"), F.col("title").alias("entity"))
    own = resolve(own, "entity", model_moves) if model_moves is not None else own
    return own.join(asked, "page").groupBy("title", "name").agg(F.max("entity").alias("entity"))


def translated(candidates: DataFrame, translations: DataFrame, names: DataFrame) -> DataFrame:
    """candidates (title, name, entity) with the names and entities of another language: (title, name, entity), by translations (title, translated) and names (title, name) of that language."""
    moved = linking.translated_candidates(candidates.select(F.col("title").alias("page"), F.col("entity").alias("title")), translations, names)
    return moved.select(F.col("page").alias("title"), normalize_mention("name", lower=True).alias("name"), F.col("title").alias("entity")).groupBy("title", "name").agg(F.max("entity").alias("entity"))


def candidates_in(titles: DataFrame, title_language: str, token_language: str, links: dict[str, DataFrame], translations: DataFrame | None = None, names: dict[str, DataFrame] | None = None, **options) -> DataFrame:
    """``title_candidates`` of articles in ``title_language`` for texts in ``token_language``; links and names by language. A language without links, or without translations and names where they are needed, is an error."""
    if title_language not in links:
        raise ValueError(f"no links for {title_language}")
    own = title_candidates(titles, links[title_language], **options)
    if token_language == title_language:
        return own
    if translations is None or token_language not in (names or {}):
        raise ValueError(f"no translations to {token_language}")
    return translated(own, translations, names[token_language])


def link_entities(docs: DataFrame, candidates: DataFrame, vocab: DataFrame, longest: int | None = 10) -> DataFrame:
    """(page, start, end, title) of docs (page, article, words): from each word on the longest of the article's candidates (title, name, entity) wins and linking goes on behind it; only entities of vocab (title) come out, though others take their words too.

    Words are compared in normal form. A page is there once.
    """
    kind = dict(docs.dtypes)["page"]
    lower = docs.select("page", "article", F.transform("words", lambda w: F.lower(w)).alias("words"))
    runs = name_runs(lower.select(F.struct("page", "article").alias("page"), "words"), candidates.select("name"), longest)
    hits = runs.select("page.page", F.col("page.article").alias("title"), "name", "start", (F.col("start") + F.col("n")).alias("end")).join(candidates, ["title", "name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, at = object(), 0
        for batch in batches:
            stays = []
            for p, start, end in zip(*[batch.column(c).to_pylist() for c in ("page", "start", "end")], strict=True):
                if p != page:
                    page, at = p, 0
                stays.append(start >= at)
                at = end if start >= at else at
            yield batch.filter(pa.array(stays, pa.bool_()))

    ordered = hits.select("page", "start", "end", F.col("entity").alias("title")).repartition("page").sortWithinPartitions("page", "start", F.desc("end"))
    return ordered.mapInArrow(run, f"page {kind}, start int, end int, title string").join(vocab.select("title").distinct(), "title", "left_semi").select("page", "start", "end", "title")


def squad_candidates(spark: SparkSession, path: str, links: DataFrame, out: str, **options) -> None:
    """Write the candidates of all articles of a question file as JSON lines {title, names: {name: entity}} under ``out``; an article without candidates has an empty object."""
    titles = files.question_titles(spark, path).distinct()
    found = title_candidates(titles, links, **options).groupBy("title").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "entity")))).alias("names"))
    none = F.expr("cast(map() as map<string,string>)")
    titles.join(found, "title", "left").select("title", F.coalesce("names", none).alias("names")).write.mode("overwrite").json(out)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(title, name, entity) as ``squad_candidates`` leaves them."""
    return spark.read.schema("title string, names map<string,string>").json(path).select("title", F.explode("names").alias("name", "entity"))


def evaluate_files(spark: SparkSession, gold: str, predicted: str) -> DataFrame:
    """(exact_match, f1, total) in percent of a prediction file against a question file, whose name tells the language that answers are compared in; questions without a prediction don't count, an id that is there twice is an error."""
    language, marks = files.answer_language(gold)
    asked = files.questions(spark, gold)
    answers = unique_by(asked.select("qid", "answers"), "qid").select("qid", F.explode_outer(F.col("answers.text")).alias("answer"))
    per = scores.answer_scores(files.predictions(spark, predicted), answers.select("qid", F.coalesce("answer", F.lit("")).alias("answer")), language, unicode_marks=marks)
    return scores.corpus_scores(per, False)


def labels_of(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """ids (id, ...) with the label that labels (id, label) gives each, null for one that it doesn't know."""
    return ids.join(labels.select("id", "label"), "id", "left")


def correct_ids(per: DataFrame) -> DataFrame:
    """(qid) of the questions that per (qid, exact) holds an exact answer of."""
    return per.filter("exact = 1").select("qid")


def by_prior(mentions: DataFrame) -> DataFrame:
    """mentions (candidates: array of struct<title, prior>, ...) with candidates by falling prior; equal ones stay in order."""
    ranked = F.array_sort(F.transform("candidates", lambda c, i: F.struct((-c["prior"]).alias("minus"), i.alias("i"), c.alias("c"))))
    return mentions.withColumn("candidates", F.transform(ranked, lambda x: x["c"]))


def answers_or_empty(answers: DataFrame, ids: DataFrame) -> DataFrame:
    """``answers`` (id, rank, text, score), and for those of ids (id) that have none the answer 'empty' of score 0."""
    none = ids.select("id").distinct().join(answers.select("id"), "id", "left_anti")
    return answers.select("id", "rank", "text", "score").unionByName(none.select("id", F.lit(1).alias("rank"), F.lit("empty").alias("text"), F.lit(0.0).alias("score")))


@F.arrow_udf(ArrayType(StringType()))
def _span_tags(places: pa.Array, spans: pa.Array) -> pa.Array:
    """The tag at each place, which rise, by the spans (start, end, label) of a document; null spans: none."""
    size, own = (x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (places, spans))
    flat, found = places.flatten(), spans.flatten()
    start, end, label = (pc.struct_field(found, c) for c in ("start", "end", "label"))
    named = pc.and_(pc.less(start, end), pc.invert(pc.is_in(label, pa.array(["NIL", "O", None], pa.string())))).fill_null(False)
    row_of = np.repeat(np.arange(len(own)), own)[named.to_numpy(zero_copy_only=False)]
    start, end = (x.filter(named).to_numpy(zero_copy_only=False).astype(np.int64) for x in (start, end))
    coded = label.filter(named).dictionary_encode()
    code_of = coded.indices.to_numpy(zero_copy_only=False)
    unknown = flat.is_null().to_numpy(zero_copy_only=False)
    pos, row = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(size)), size)
    code, first = np.full(len(pos), -1), np.zeros(len(pos), bool)
    if len(start) and len(pos):
        # a document's places lie behind those of the one before
        low = min(pos.min(), start.min())
        width = max(pos.max() + 1, end.max()) - low
        order = np.lexsort((start, row_of))
        begin, stop, kinds = (start - low + row_of * width)[order], (end - low + row_of * width)[order], code_of[order]
        at = pos - low + row * width
        of = np.searchsorted(begin, at, side="right") - 1
        code = np.where((of >= 0) & (at < stop[of]) & ~unknown, kinds[of], -1)
        head = np.append(True, row[1:] != row[:-1])
        first = (at == begin[of]) & (np.append(-1, code[:-1]) == code) & ~head
    values = ["O"] + [f"{x}-{k}" for k in coded.dictionary.to_pylist() for x in "IB"]
    tags = pa.DictionaryArray.from_arrays(pa.array(np.where(code < 0, 0, 1 + 2 * code + first).astype(np.int32)), pa.array(values, pa.string()))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), tags.cast(pa.string()))


def tag_lists(docs: DataFrame) -> DataFrame:
    """docs (places: array<long>, rising, spans: array of struct<start, end, label> that don't overlap, ...) with preds, the tag at each place as ``sentence_tags`` has it; a document is a row, and nothing is shuffled."""
    small_batches(docs.sparkSession)
    return docs.withColumn("preds", _span_tags("places", "spans"))


def sentence_tags(spans: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, sentence, pos, word, label, pred) for words (doc, pos, sentence, word, label), pos through the document: spans (doc, start, end, label) that don't overlap as tags, cut at sentences; spans labelled NIL or O count as none.

    Words meet as one row for each document. A tag in a sentence is I- where the word before it, through the document, has another type, else
    B- at its span's first word: so one that goes on behind a sentence's end stays I-.
    """
    lists = words.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence", "word", "label"))).alias("words"))
    own = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "label")).alias("spans"))
    rows = tag_lists(lists.join(own, "doc", "left").withColumn("places", F.col("words.pos").cast("array<long>")))
    return rows.select("doc", F.explode(F.arrays_zip("words", "preds")).alias("w")).select("doc", "w.words.sentence", "w.words.pos", "w.words.word", "w.words.label", F.col("w.preds").alias("pred"))
