"""Readers of annotation files; Spark opens all paths."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.session import keep


def lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file, line, text) of all lines, counted from 0 in each file; ``recursive``: of folders within too. What follows a file's last line break is a line only if it isn't empty.

    Large files are read in splits. A line's number is its place in the split and the lines of the
    file's splits before it, of which only a row for each split meets the others.
    """
    value = F.regexp_replace("value", "\r$", "").alias("text")
    raw = spark.read.option("recursiveFileLookup", recursive).option("lineSep", "\n").text(path)
    raw = raw.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("__from"), F.monotonically_increasing_id().alias("__id"), value)
    before = Window.partitionBy("file").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "__from").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return raw.join(F.broadcast(splits), ["file", "__from"]).select("file", (F.col("__id") - F.col("__first") + F.col("__before")).cast("int").alias("line"), "text")


def vocab_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, count): the line's number, title and count."""
    rows = lines(spark, path).filter("text <> ''").withColumn("f", F.split("text", "\t"))
    return rows.select(F.col("line").alias("id"), F.get("f", F.lit(0)).alias("title"), F.get("f", F.lit(1)).try_cast("long").alias("count"))


def vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, lang, count) from lines {id, entities: [[title, lang]], count}."""
    rows = spark.read.schema("id int, entities array<array<string>>, count long").json(path)
    return rows.select("id", F.explode("entities").alias("e"), "count").select("id", F.get("e", F.lit(0)).alias("title"), F.get("e", F.lit(1)).alias("lang"), "count")


def tokenizer_vocab(spark: SparkSession, path: str, special: tuple[str, ...] = ("[PAD]", "[UNK]", "[MASK]", "[MASK2]")) -> DataFrame:
    """(id, title, lang, count) from one object of keys lang:title; special keys have no language, counts are null."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("key", "id"))
    parts, plain = F.split("key", ":", 2), F.col("key").isin(*special)
    return whole.select("id", F.when(plain, F.col("key")).otherwise(F.get(parts, F.lit(1))).alias("title"), F.when(~plain, F.get(parts, F.lit(0))).alias("lang"), F.lit(None).cast("long").alias("count"))


def sitelinks(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """(item, title, lang) of a knowledge base's dump: a JSON object on each line between [ and ], items only, sites that end in wiki."""
    rows = spark.read.text(path).filter(~F.trim("value").isin("[", "]", "")).select(F.regexp_replace("value", r",\s*$", "").alias("value"))
    parsed = rows.select(F.from_json("value", "id string, type string, sitelinks map<string,struct<site:string,title:string>>").alias("x")).filter("x.type = 'item'")
    links = parsed.select(F.col("x.id").alias("item"), F.explode(F.map_values("x.sitelinks")).alias("s")).filter(F.col("s.site").endswith("wiki"))
    out = links.select("item", "s.title", F.regexp_replace("s.site", "wiki$", "").alias("lang"))
    return out.filter(F.col("lang").isin(*languages)) if languages else out


def relation_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, sentence, label) with <ent> around the subject and <ent2> around the object; ends in the file are inclusive."""
    rows = spark.read.schema("id string, token array<string>, subj_start int, subj_end int, obj_start int, obj_end int, relation string").option("multiLine", True).json(path)

    def around(tokens: Column, start: Column, end: Column, mark: str) -> Column:
        n = F.size(tokens)
        return F.concat(F.slice(tokens, F.lit(1), start), F.array(F.lit(mark)), F.slice(tokens, start + 1, end - start + 1), F.array(F.lit(mark)), F.slice(tokens, end + 2, F.greatest(F.lit(0), n - end - 1)))

    subj_last = F.col("subj_start") > F.col("obj_start")
    # the later span first, so that the earlier one's places still hold
    one = F.when(subj_last, around(F.col("token"), F.col("subj_start"), F.col("subj_end"), "<ent>")).otherwise(around(F.col("token"), F.col("obj_start"), F.col("obj_end"), "<ent2>"))
    rows = rows.withColumn("one", one)
    two = F.when(subj_last, around(F.col("one"), F.col("obj_start"), F.col("obj_end"), "<ent2>")).otherwise(around(F.col("one"), F.col("subj_start"), F.col("subj_end"), "<ent>"))
    text = F.regexp_replace(F.regexp_replace(F.array_join(two, " "), r"<ent>(.*?)<ent>", "<ent>$1<ent>"), r" (<ent2?>) ", " $1 ")
    return rows.select("id", text.alias("sentence"), F.col("relation").alias("label"))


def relation_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(id, sentence, label) from blocks of two lines, id and quoted sentence by a tab, then the label; <e1> and <e2> become <ent> and <ent2>."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\r?\n\s*\r?\n")).alias("b"))
    two = blocks.select(F.split(F.trim("b"), r"\r?\n").alias("l")).withColumn("f", F.split(F.get("l", F.lit(0)), "\t"))
    text = F.regexp_replace(F.get("f", F.lit(1)), r'^"\s*|\s*"$', "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"</?e1>", "<ent>"), r"</?e2>", "<ent2>"), r" \.", ".")
    return two.select(F.get("f", F.lit(0)).alias("id"), text.alias("sentence"), F.trim(F.get("l", F.lit(1))).alias("label"))


#: The coarse classes that typing keeps.
COARSE = ("entity", "event", "group", "location", "object", "organization", "person", "place", "time")


def typing_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, sentence, labels): left context, the mention between <ent>, right context; coarse classes only; bracket tokens as (."""
    kind = "annot_id string, y_str array<string>, mention_span string, left_context_token array<string>, right_context_token array<string>"
    rows = spark.read.schema(kind).json(path)
    sentence = F.concat_ws(" ", F.array_join("left_context_token", " "), F.lit("<ent>"), F.col("mention_span"), F.lit("<ent>"), F.array_join("right_context_token", " "))
    return rows.select(F.col("annot_id").alias("id"), F.trim(F.regexp_replace(sentence, "-L[RCS]?B-", "(")).alias("sentence"), F.array_intersect("y_str", F.array(*[F.lit(c) for c in COARSE])).alias("labels"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, title, context, question, answers, is_impossible) of question-answering JSON; _ in titles becomes a space, %-signs are decoded."""
    answer = "array<struct<text:string,answer_start:int>>"
    kind = f"data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:{answer},is_impossible:boolean>>>>>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("data").alias("d"))
    paras = rows.select(F.col("d.title").alias("title"), F.explode("d.paragraphs").alias("p"))
    qas = paras.select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    title = F.replace(F.url_decode(F.replace("title", F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))
    return qas.select(F.col("q.id").alias("qid"), title.alias("title"), "context", "q.question", "q.answers", F.coalesce("q.is_impossible", F.lit(False)).alias("is_impossible"))


def cloze(spark: SparkSession, path: str) -> DataFrame:
    """(qid, context, query, entities, answers) of cloze JSON; ends in the file are inclusive, here exclusive, and entities carry their text."""
    span = "array<struct<start:int,end:int,text:string>>"
    kind = f"data array<struct<passage:struct<text:string,entities:{span}>,qas:array<struct<id:string,query:string,answers:{span}>>>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("data").alias("d"))
    rows = rows.select("d.passage", F.explode("d.qas").alias("q"))
    open_end = lambda e: F.struct(e["start"].alias("start"), (e["end"] + 1).alias("end"), F.substring(F.col("passage.text"), e["start"] + 1, e["end"] + 1 - e["start"]).alias("text"))
    return rows.select(F.col("q.id").alias("qid"), F.col("passage.text").alias("context"), F.col("q.query").alias("query"), F.transform("passage.entities", open_end).alias("entities"), F.transform("q.answers", open_end).alias("answers"))


def candidates_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc, mention, text, gold, candidates: array of struct<title, prior>) of disambiguation TSV.

    Field 0 is the document, 2 the mention, from 6 on candidates id,prior,title (titles may have
    commas) until the last, which is the gold: -1 takes its title from field 2, another from field
    3. Mentions without a gold title go; the rest are numbered anew in each document; candidates
    come by falling prior.
    """
    rows = lines(spark, path).filter("text <> ''").withColumn("f", F.split(F.replace("text", F.lit("&amp;"), F.lit("&")), "\t"))
    raw = F.filter(F.slice("f", F.lit(7), F.greatest(F.lit(0), F.size("f") - 7)), lambda c: (c != "EMPTYCAND") & (F.size(F.split(c, ",")) >= 3))
    parsed = F.transform(raw, lambda c: F.struct(F.get(F.split(c, ",", 3), F.lit(2)).alias("title"), F.get(F.split(c, ",", 3), F.lit(1)).cast("double").alias("prior")))
    ordered = F.transform(F.array_sort(F.transform(parsed, lambda c, i: F.struct((-c["prior"]).alias("minus"), i.alias("i"), c.alias("c")))), lambda x: x["c"])
    parts = F.split(F.element_at("f", -1), ",", 4)
    gold = F.when(F.get(parts, F.lit(0)) == "-1", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(3)))
    out = rows.select("file", "line", F.get("f", F.lit(0)).alias("doc"), F.get("f", F.lit(2)).alias("text"), gold.alias("gold"), ordered.alias("candidates")).filter("gold <> ''")
    return out.withColumn("mention", F.row_number().over(Window.partitionBy("file", "doc").orderBy("line")) - 1).drop("line")


def prior_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(name, total, prob, title) of lines name, total, then id,prob,title with _ for spaces."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    rows = rows.select(F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).cast("long").alias("total"), F.explode(F.slice("f", 3, 1 << 20)).alias("c")).filter("c <> ''")
    parts = F.split("c", ",", 3)
    return rows.select("name", "total", F.get(parts, F.lit(1)).cast("double").alias("prob"), F.replace(F.get(parts, F.lit(2)), F.lit("_"), F.lit(" ")).alias("title"))


def titles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("title")).filter("title <> ''")


def redirects_tsv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.size("f") == 2)
    return rows.select(F.get("f", F.lit(0)).alias("src"), F.get("f", F.lit(1)).alias("dest"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text) of one JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("qid", "text"))


def typing_spans(spark: SparkSession, path: str) -> DataFrame:
    """(id, sentence, start, end, labels) of one JSON array of typing examples, numbered in order."""
    kind = "array<struct<sent:string,start:int,end:int,labels:array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)).alias("id", "x"))
    return rows.select("id", F.col("x.sent").alias("sentence"), "x.start", "x.end", "x.labels")


def question_set(path: Column | str) -> Column:
    """(dataset, question_lang, context_lang, title_lang) that a question file's name tells; null for other names."""
    name = F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)
    english, crossed = F.regexp_extract(name, r"^xquad\.(..)\.json$", 1), r"^(?:dev|test)-context-(..)-question-(..)\.json$"
    context, question = F.regexp_extract(name, crossed, 1), F.regexp_extract(name, crossed, 2)

    def told(dataset: str, question: Column, context: Column, title: Column) -> Column:
        return F.struct(F.lit(dataset).alias("dataset"), question.alias("question_lang"), context.alias("context_lang"), title.alias("title_lang"))

    en = F.lit("en")
    return F.when(name.rlike(r"^(?:train|dev)-v(?:1\.1|2\.0)\.json$"), told("squad", en, en, en)).when(english != "", told("xquad", english, english, en)).when(context != "", told("mlqa", question, context, context))


def question_titles(spark: SparkSession, path: str) -> DataFrame:
    """(title) of the articles of question-answering JSON, with spaces for _."""
    rows = spark.read.schema("data array<struct<title:string>>").option("multiLine", True).json(path).select(F.explode("data.title").alias("title"))
    return rows.select(F.replace("title", F.lit("_"), F.lit(" ")).alias("title"))


def mention_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Words (file, doc, pos, word) and mentions (file, doc, mention, start, end) of tab-separated lines.

    -DOCSTART- lines name documents. A line of six fields or more is part of a mention: B begins
    one and I makes it longer by a word; another tag is an error. Blank lines hold a place, as an
    empty word, but for the one behind a file's last line break. For mentions lines stay where they
    are read: what is shuffled are their places, in lists.
    """
    rows = lines(spark, path)
    last = F.max("line").over(Window.partitionBy("file"))
    rows = rows.withColumn("text", F.trim("text")).withColumn("__last", last).filter("not (line = __last and text = '')").drop("__last")
    start = F.col("text").startswith("-DOCSTART-")
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.when(start, F.substring(F.get(F.split("text", r"\s+"), F.lit(1)), 2, 1 << 20))
    rows = rows.withColumn("doc", F.last(name, ignorenulls=True).over(upto)).filter(~start).withColumn("f", F.split("text", "\t"))
    words = rows.withColumn("pos", F.row_number().over(Window.partitionBy("file", "doc").orderBy("line")) - 1)
    return words.select("file", "doc", "pos", F.get("f", F.lit(0)).alias("word")), _mention_spans(spark, path)


def _mention_spans(spark: SparkSession, path: str) -> DataFrame:
    """The mentions of ``mention_lines``: a split's pieces of documents, then each piece's places from what the document's pieces before it come to."""
    value = F.trim(F.regexp_replace("value", "\r$", "")).alias("text")
    raw = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("from"), value)
    pieces = keep(raw.mapInArrow(_mention_pieces, "file string, from long, k long, doc string, n long, lead int, starts array<int>, sizes array<int>"), "pieces")
    # a split's first piece may go on with a document of the splits before; only a row for each split meets the others
    ends = pieces.groupBy("file", "from").agg(F.max(F.when(F.col("doc").isNotNull(), F.struct("k", "doc"))).alias("end"))
    before = Window.partitionBy("file").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "from", F.last("end.doc", ignorenulls=True).over(before).alias("__doc"))
    own = pieces.join(F.broadcast(ends), ["file", "from"]).withColumn("doc", F.coalesce("doc", "__doc"))
    upto = Window.partitionBy("file", "doc").orderBy("from", "k").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("__words", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("__begun", F.coalesce(F.sum(F.size("starts") - F.col("lead")).over(upto), F.lit(0)))
    runs = own.select("file", "doc", "lead", "__words", "__begun", F.posexplode(F.arrays_zip("starts", "sizes")).alias("i", "run"))
    runs = runs.select("file", "doc", (F.col("__begun") + F.col("i") - F.col("lead")).alias("mention"), (F.col("__words") + F.col("run.starts")).cast("int").alias("start"), F.col("run.sizes").alias("n"))
    spans = runs.groupBy("file", "doc", "mention").agg(F.min("start").alias("start"), F.sum("n").alias("n"))
    return spans.select("file", "doc", "mention", "start", (F.col("start") + F.col("n")).cast("int").alias("end"))


def _mention_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, from, text) in order -> a row for each piece of a document that a batch holds of a split.

    k: its place in the split; doc: null before the split's first name; n: its words; starts, sizes:
    its mentions, the first of which goes on with one from before if lead is 1.
    """
    at, k, doc = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        where = pa.StructArray.from_arrays([batch.column(c) for c in ("file", "from")], ["file", "from"])
        changed = np.logical_or.reduce([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in where.flatten()]) if len(where) > 1 else np.zeros(0, bool)
        for low, high in itertools.pairwise([0, *(np.flatnonzero(changed) + 1).tolist(), len(where)]):
            here = where[low].as_py()
            if here != at:
                at, k, doc = here, 0, None
            text = batch.column("text").slice(low, high - low)
            head = pc.starts_with(text, "-DOCSTART-").to_numpy(zero_copy_only=False)
            piece = np.cumsum(head)
            first = np.append(0, np.flatnonzero(head) + 1)  # of each piece; the one before the first name may have no lines
            docs = [doc]
            for x in text.filter(pa.array(head)).to_pylist():
                found = re.split(r"[ \t\n\x0b\f\r]+", x)
                doc = found[1][1:] if len(found) > 1 else doc
                docs.append(doc)
            tagged = np.flatnonzero((pc.count_substring(text, "\t").to_numpy(zero_copy_only=False) >= 5) & ~head)
            tags = pc.list_element(pc.split_pattern(text.take(pa.array(tagged)), "\t", max_splits=2), 1) if len(tagged) else pa.array([], pa.string())
            begins = pc.equal(tags, "B").to_numpy(zero_copy_only=False)
            wrong = ~begins & ~pc.equal(tags, "I").to_numpy(zero_copy_only=False)
            if wrong.any():
                raise ValueError(f"no mention tag: {tags[int(np.flatnonzero(wrong)[0])].as_py()}")
            of = piece[tagged]
            opens = np.flatnonzero(begins | np.append(True, of[1:] != of[:-1])[: len(of)])
            sizes = np.diff(np.append(opens, len(of)))
            n = np.diff(np.append(first, len(text) + 1)) - 1
            count = np.bincount(of[opens], minlength=len(docs))
            lead = np.bincount(of[opens], ~begins[opens], minlength=len(docs))
            offsets = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in ((tagged - first[piece[tagged]])[opens], sizes)]
            same = [pa.array([at[c]] * len(docs), t) for c, t in (("file", pa.string()), ("from", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(k, k + len(docs))), pa.array(docs, pa.string()), pa.array(n.astype(np.int64)), pa.array(lead.astype(np.int32)), *lists], ["file", "from", "k", "doc", "n", "lead", "starts", "sizes"])
            k += len(docs)


def entity_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(doc, entity, text, titles) of files, one for each document and named after it, in ``path`` and the folders within.

    ENTITY lines say in field 7, behind nine characters, what the mention reads; the CANDIDATE
    lines up to the next name titles in field 5, behind 33 characters and with _ for spaces.
    """
    rows = lines(spark, path, recursive=True).withColumn("f", F.split("text", "\t"))
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head, candidate = F.col("text").startswith("ENTITY"), F.col("text").startswith("CANDIDATE")
    rows = rows.withColumn("entity", F.sum(head.cast("int")).over(upto) - 1).filter((head | candidate) & (F.col("entity") >= 0))
    title = F.replace(F.substring(F.get("f", F.lit(5)), 34, 1 << 20), F.lit("_"), F.lit(" "))
    titles = F.array_sort(F.collect_list(F.when(candidate, F.struct("line", title.alias("title")))))
    found = rows.groupBy("file", "entity").agg(F.max(F.when(head, F.substring(F.get("f", F.lit(7)), 10, 1 << 20))).alias("text"), titles.alias("titles"))
    return found.select(F.substring_index("file", "/", -1).alias("doc"), "entity", "text", F.col("titles.title").alias("titles"))


def relation_spans(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, subj, obj, label): tokens joined by spaces, and the character spans (start, end) of subject and object; ends in the file are inclusive."""
    rows = spark.read.schema("id string, token array<string>, subj_start int, subj_end int, obj_start int, obj_end int, relation string").option("multiLine", True).json(path)

    def span(a: str, b: str) -> Column:
        before, own = F.array_join(F.slice("token", F.lit(1), F.col(a)), " "), F.array_join(F.slice("token", F.col(a) + 1, F.col(b) - F.col(a) + 1), " ")
        start = F.length(before) + F.when(F.col(a) > 0, 1).otherwise(0)
        return F.struct(start.alias("start"), (start + F.length(own)).alias("end"))

    return rows.select("id", F.array_join("token", " ").alias("text"), span("subj_start", "subj_end").alias("subj"), span("obj_start", "obj_end").alias("obj"), F.col("relation").alias("label"))


def candidate_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pair, page, name, title) from one object of language pairs, each with pages that map names to titles."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,map<string,string>>>")).alias("pair", "pages"))
    return whole.select("pair", F.explode("pages").alias("page", "names")).select("pair", "page", F.explode("names").alias("name", "title"))


def example_sets(spark: SparkSession, paths: list[str], same: list[str]) -> DataFrame:
    """The examples under several folders (as write_examples leaves them) as one table; an error unless they agree in the properties ``same``."""
    wanted = spark.read.json([f"{p}/metadata" for p in paths]).select(*same).distinct().limit(2).count()
    if wanted > 1:
        raise ValueError(f"the sets differ in {', '.join(same)}")
    return spark.read.parquet(*[f"{p}/examples" for p in paths])


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary by the kind of its file: tab-separated, or JSON lines."""
    if path.endswith(".tsv"):
        return vocab_tsv(spark, path).withColumn("lang", F.lit(None).cast("string")).select("id", "title", "lang", "count")
    if path.endswith((".jsonl", ".json")):
        return vocab_json(spark, path)
    raise ValueError(f"a vocabulary ends in .tsv or .jsonl: {path}")


def answer_language(path: str) -> tuple[str, bool]:
    """The language whose normal form an evaluation file's answers have, and whether all marks count: by names like dev-context-de-question-en.json, else English with ASCII marks."""
    found = re.search(r"context-(\w\w)-question", path.rpartition("/")[2])
    return (found[1], True) if found else ("en", False)


def looked_up(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``table``, as write_buckets leaves it, for ``keys`` (key, ...), each key once or more; the table isn't shuffled."""
    return table.join(keys.hint("shuffle_merge"), key)
