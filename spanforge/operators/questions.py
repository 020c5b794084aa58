"""Model inputs for questions over texts: tokens around links and entities, windows with their entities or answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import padded, position_ids
from spanforge.operators.windows import stride_starts

#: What marks the highlights and the gap in cloze texts.
HIGHLIGHT, PLACEHOLDER = "@highlight", "@placeholder"
_TOKENS = rf"(?U){HIGHLIGHT}|{PLACEHOLDER}|\w+|[^\w\s]"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))


def _segments(text: str, spans: str, begin: Column, stop: Column, mark: str | None = None) -> tuple[Column, Column]:
    """Tokens of ``text`` from ``begin`` to ``stop``, cut at the borders of ``spans`` (in order, apart); and each span's places among them. ``mark`` is put around each span."""
    around = F.array(F.lit(mark)) if mark else F.expr("cast(array() as array<string>)")
    piece = lambda a, b: _tokens(F.substring(F.col(text), a + 1, b - a))
    first = F.struct(begin.cast("int").alias("at"), F.expr("cast(array() as array<string>)").alias("tokens"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("places"))

    def step(state: Column, x: Column) -> Column:
        before, inner = piece(state["at"], x["start"]), F.concat(around, piece(x["start"], x["end"]), around)
        start = F.size(state["tokens"]) + F.size(before)
        place = F.struct(start.alias("start"), (start + F.size(inner)).alias("end"))
        return F.struct(x["end"].cast("int").alias("at"), F.concat(state["tokens"], before, inner).alias("tokens"), F.array_append(state["places"], place).alias("places"))

    state = F.aggregate(spans, first, step)
    return F.concat(state["tokens"], piece(state["at"], stop)), state["places"]


def linked_sentences(rows: DataFrame, least: int = 1, most: int = 1 << 30) -> DataFrame:
    """(page, sent, tokens, entities) of sentences (page, sent, text, links: the paragraph's, start, end): no token crosses a link's border; entities are (title, start, end) in tokens.

    Links that aren't whole in the sentence are left out, as are sentences of fewer than ``least``
    or more than ``most`` tokens.
    """
    whole = F.filter("links", lambda x: (x["start"] >= F.col("start")) & (x["start"] < F.col("end")) & (x["end"] <= F.col("end")))
    rows = rows.withColumn("__links", F.array_sort(F.transform(whole, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["title"].alias("title")))))
    tokens, places = _segments("text", "__links", F.col("start"), F.col("end"))
    entities = F.zip_with("__links", places, lambda x, p: F.struct(x["title"].alias("title"), p["start"].alias("start"), p["end"].alias("end")))
    return rows.select("page", "sent", tokens.alias("tokens"), entities.alias("entities")).filter(F.size("tokens").between(least, most))


def grown_context(rows: DataFrame, most: int) -> DataFrame:
    """(doc, sentence, from, to) of sentences (doc, sentence, start, end, sizes: of the document's words): all words if their sizes sum up to ``most`` at most; else the sentence's, which grow by a word on the left and on the right in turn until one would go beyond ``most``.

    A side that has come to the document's border is passed over.
    """
    n = F.size("sizes")
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x.cast("int"))
    begin = F.struct(F.col("start").cast("int").alias("from"), F.col("end").cast("int").alias("to"), total(F.slice("sizes", F.col("start") + 1, F.col("end") - F.col("start"))).alias("used"), F.lit(False).alias("full"))

    def step(state: Column, i: Column) -> Column:
        left = i % 2 == 0
        border = F.when(left, state["from"] == 0).otherwise(state["to"] == n)
        used = state["used"] + F.get("sizes", F.when(left, state["from"] - 1).otherwise(state["to"])).cast("int")
        grown = F.struct(F.when(left, state["from"] - 1).otherwise(state["from"]).alias("from"), F.when(left, state["to"]).otherwise(state["to"] + 1).alias("to"), used.alias("used"), F.lit(False).alias("full"))
        stop = F.struct(state["from"].alias("from"), state["to"].alias("to"), state["used"].alias("used"), F.lit(True).alias("full"))
        return F.when(state["full"] | border, state).when(used > most, stop).otherwise(grown)

    grown = F.aggregate(F.sequence(F.lit(0), 2 * n), begin, step)
    fits = total(F.col("sizes")) <= most
    return rows.select("doc", "sentence", F.when(fits, 0).otherwise(grown["from"]).alias("from"), F.when(fits, n).otherwise(grown["to"]).alias("to"))


def _windows(rows: DataFrame, question: str, context: str, most: int, stride: int, double: bool) -> DataFrame:
    """``rows`` with window, w_start, w_size, tokens, segments and offset (where the window's words begin): [CLS] question [SEP] window [SEP], with two [SEP] between if ``double``."""
    room = F.lit(most) - F.size(question) - (4 if double else 3)
    one = rows.withColumn("__room", room).select("*", F.posexplode(stride_starts(F.size(context), F.col("__room"), stride)).alias("window", "w_start"))
    one = one.withColumn("w_start", F.col("w_start").cast("int")).withColumn("w_size", F.least(F.col("__room"), F.size(context) - F.col("w_start")).cast("int"))
    sep = F.array(F.lit("[SEP]"))
    gap = F.concat(sep, sep) if double else sep
    offset = F.size(question) + (3 if double else 2)
    tokens = F.concat(F.array(F.lit("[CLS]")), question, gap, F.slice(context, F.col("w_start") + 1, F.col("w_size")), sep)
    segments = F.concat(F.array_repeat(F.lit(0), F.size(question) + 2), F.array_repeat(F.lit(1), F.col("w_size") + (2 if double else 1)))
    return one.withColumns({"tokens": tokens, "segments": segments, "offset": offset}).drop("__room")


def question_windows(rows: DataFrame, most: int, stride: int, most_question: int, double: bool = False) -> DataFrame:
    """(id, window, tokens, segments, offset, w_start, start, end) of rows (id, question, context: tokens; start, end: the answer in the context, inclusive, or null).

    start and end are the answer's places in ``tokens``; 0 where a window doesn't hold all of it.
    """
    cut = rows.withColumn("question", F.slice("question", 1, most_question))
    out = _windows(cut, "question", "context", most, stride, double)
    holds = (F.col("start") >= F.col("w_start")) & (F.col("end") < F.col("w_start") + F.col("w_size"))
    place = lambda c: F.when(holds, F.col(c) - F.col("w_start") + F.col("offset")).otherwise(0).cast("int").alias(c)
    return out.select("id", "window", "tokens", "segments", "offset", "w_start", place("start"), place("end"))


def cloze_features(rows: DataFrame, most: int, stride: int, most_query: int, double: bool = False) -> DataFrame:
    """(id, window, tokens, segments, placeholder, entities) of cloze rows (qid, context, query, entities, answers; exclusive ends).

    The query's gap and highlights are tokens of their own, and [ENTITY] stands around each entity
    of the context. entities are (start, end, answer) in ``tokens``, of those whole in the window;
    windows without any are left out. placeholder is the gap's place; a query has one.
    """
    flat = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit(" "))
    spans = F.array_sort(F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))))
    rows = rows.select(F.col("qid").alias("id"), flat("context").alias("__text"), F.slice(_tokens(flat("query")), 1, most_query).alias("__query"), spans.alias("__spans"), "answers")
    tokens, places = _segments("__text", "__spans", F.lit(0), F.length("__text"), "[ENTITY]")
    right = F.transform("__spans", lambda e: F.exists("answers", lambda a: (a["start"] == e["start"]) & (a["end"] == e["end"])))
    rows = rows.select("id", "__query", tokens.alias("__context"), F.arrays_zip(places.alias("place"), right.alias("answer")).alias("__entities"))
    out = _windows(rows, "__query", "__context", most, stride, double)
    whole = F.filter("__entities", lambda e: (e["place"]["start"] >= F.col("w_start")) & (e["place"]["end"] <= F.col("w_start") + F.col("w_size")))
    move = F.col("offset") - F.col("w_start")
    entities = F.transform(whole, lambda e: F.struct((e["place"]["start"] + move).alias("start"), (e["place"]["end"] + move).alias("end"), e["answer"].alias("answer")))
    gap = F.array_position("__query", PLACEHOLDER).cast("int")
    return out.select("id", "window", "tokens", "segments", gap.alias("placeholder"), entities.alias("entities")).filter(F.size("entities") > 0)


def cloze_inputs(features: DataFrame, length: int, most_entities: int) -> DataFrame:
    """(id, window, entity_ids, positions, labels) of cloze features: the gap is entity 0, all ids are 1, places cut or padded to ``length``; labels (of the entities without the gap) and ids are padded with 0 to ``most_entities``."""
    gap = position_ids(F.col("placeholder"), F.col("placeholder") + 1, length)
    positions = F.concat(F.array(gap), F.transform("entities", lambda e: position_ids(e["start"], e["end"], length)))
    ids = padded(F.array_repeat(F.lit(1), F.size("entities") + 1), most_entities + 1)
    labels = padded(F.transform("entities", lambda e: e["answer"].cast("int")), most_entities)
    return features.select("id", "window", ids.alias("entity_ids"), positions.alias("positions"), labels.alias("labels"))
