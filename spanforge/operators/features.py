"""Features of tasks: marked token sequences, links of sentences, splits of documents, pooled vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _list(*tokens: str) -> Column:
    return F.array(*[F.lit(t) for t in tokens])


def typing_features(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(id, tokens, start, end, hot): [CLS] left [ENTITY] mention [ENTITY] right [SEP]; the span holds both marks; hot says which of ``labels`` apply."""
    tokens = F.concat(_list("[CLS]"), "left", _list("[ENTITY]"), "mention", _list("[ENTITY]"), "right", _list("[SEP]"))
    start = F.size("left") + 1
    return rows.select("id", tokens.alias("tokens"), start.alias("start"), (start + F.size("mention") + 2).alias("end"), F.array(*[F.array_contains("labels", x).cast("int") for x in labels]).alias("hot"))


def relation_features(rows: DataFrame) -> DataFrame:
    """(id, tokens, head, tail): tokens with [HEAD] and [TAIL] around the spans (head_start, head_end, tail_start, tail_end; exclusive ends); head and tail are the marked spans.

    The span that ends later is marked first, so that the other's places still hold.
    """

    def mark(tokens: Column, start: Column, end: Column, sign: str) -> Column:
        return F.concat(F.slice(tokens, F.lit(1), start), _list(sign), F.slice(tokens, start + 1, end - start), _list(sign), F.slice(tokens, end + 1, F.size(tokens)))

    first = F.col("head_end") <= F.col("tail_end")
    one = F.when(first, mark(F.col("tokens"), F.col("tail_start"), F.col("tail_end"), "[TAIL]")).otherwise(mark(F.col("tokens"), F.col("head_start"), F.col("head_end"), "[HEAD]"))
    rows = rows.withColumn("__one", one)
    two = F.when(first, mark(F.col("__one"), F.col("head_start"), F.col("head_end"), "[HEAD]")).otherwise(mark(F.col("__one"), F.col("tail_start"), F.col("tail_end"), "[TAIL]"))
    span = lambda name, moved: F.struct((F.col(f"{name}_start") + moved).alias("start"), (F.col(f"{name}_end") + 2 + moved).alias("end"))
    return rows.select("id", two.alias("tokens"), span("head", F.when(first, 0).otherwise(2)).alias("head"), span("tail", F.when(first, 2).otherwise(0)).alias("tail"))


def label_list(rows: DataFrame, first: str | None = None) -> DataFrame:
    """(id, label) of the labels of rows (label), ``first`` at 0, the others in order."""
    # a task's labels are few: one array of them is put in order
    ranked = F.array_sort(F.collect_set(F.struct((F.col("label") != (first or "")).cast("int").alias("later"), "label")))
    return rows.filter("label is not null").agg(ranked.alias("all")).select(F.posexplode("all").alias("id", "x")).select("id", "x.label")


def passage_features(rows: DataFrame, double: bool = False) -> DataFrame:
    """(id, tokens, segments, a_offset, b_offset): [CLS] a [SEP] b [SEP], with two [SEP] between if ``double``."""
    gap = _list("[SEP]", "[SEP]") if double else _list("[SEP]")
    head = F.size("a") + 1 + (2 if double else 1)
    return rows.select("id", F.concat(_list("[CLS]"), "a", gap, "b", _list("[SEP]")).alias("tokens"), F.concat(F.array_repeat(F.lit(0), head), F.array_repeat(F.lit(1), F.size("b") + 1)).alias("segments"), F.lit(1).alias("a_offset"), head.alias("b_offset"))


_LINK = "struct<text:string,title:string,start:int,end:int>"


def blank_categories(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` (text, links) where links to categories whose text also says so are gone and their text is spaces; a link of which only the title says so stays."""
    is_category = lambda x: x["title"].startswith("Category:") & F.lower(x["text"]).startswith("category:")
    text = F.aggregate(F.filter("links", is_category), F.col("text"), lambda t, x: F.overlay(t, F.repeat(F.lit(" "), x["end"] - x["start"]), x["start"] + 1, x["end"] - x["start"]))
    return paragraphs.withColumn("text", text).withColumn("links", F.filter("links", lambda x: ~is_category(x)))


def links_of_sentences(rows: DataFrame) -> DataFrame:
    """``rows`` (sent_start, sent_end, links of the paragraph) with the links whole in the sentence, from its start on; those that straddle its end go."""
    inside = F.filter("links", lambda x: (x["start"] >= F.col("sent_start")) & (x["start"] < F.col("sent_end")) & (x["end"] <= F.col("sent_end")))
    return rows.withColumn("links", F.transform(inside, lambda x: F.struct(x["text"].alias("text"), x["title"].alias("title"), (x["start"] - F.col("sent_start")).cast("int").alias("start"), (x["end"] - F.col("sent_start")).cast("int").alias("end"))))


def mention_contexts(mentions: DataFrame, most: int) -> DataFrame:
    """(doc, mention, from, to): the words around each mention (start, end of n words), ``most`` in all, evenly as far as the document allows."""
    room = F.greatest(F.lit(0), F.lit(most) - (F.col("end") - F.col("start")))
    left_all, right_all, half = F.col("start"), F.col("n") - F.col("end"), F.floor(room / 2)
    left = F.when(left_all < right_all, F.least(left_all, half)).otherwise(F.least(left_all, room - F.least(right_all, half)))
    rows = mentions.withColumn("__left", left)
    return rows.select("doc", "mention", (F.col("start") - F.col("__left")).alias("from"), (F.col("end") + F.least(right_all, room - F.col("__left"))).alias("to"))


def improved_span(rows: DataFrame) -> DataFrame:
    """(id, start, end): inside an answer's span (tokens, start, end inclusive) the first span whose tokens are the answer's, or the whole."""
    width = F.size("answer")
    starts = F.filter(F.sequence(F.col("start"), F.greatest(F.col("start"), F.col("end") - width + 1)), lambda i: F.slice(F.col("tokens"), i + 1, width) == F.col("answer"))
    found = F.size(starts) > 0
    return rows.select("id", F.when(found, F.get(starts, F.lit(0))).otherwise(F.col("start")).alias("start"), F.when(found, F.get(starts, F.lit(0)) + width - 1).otherwise(F.col("end")).alias("end"))


def mean_vectors(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, dim, value): the mean of vectors, component by component; null ones don't count."""
    parts = rows.select(by, F.posexplode(vector).alias("dim", "x"))
    return parts.groupBy(by, "dim").agg(F.avg("x").alias("value"))


def max_vectors(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, dim, value): the largest of vectors, component by component."""
    parts = rows.select(by, F.posexplode(vector).alias("dim", "x"))
    return parts.groupBy(by, "dim").agg(F.max("x").alias("value"))


def global_step(rows: DataFrame) -> DataFrame:
    """Of scored candidates (doc, mention, title, score) of open mentions each document's most confident mention and title."""
    return rows.groupBy("doc").agg(F.max_by(F.struct("mention", "title", "score"), F.struct("score", -F.col("mention"))).alias("x")).select("doc", "x.*")


def masked_scores(scores: Column, allowed: Column) -> Column:
    """Scores with those that aren't allowed out of reach."""
    return F.zip_with(scores, allowed, lambda s, a: F.when(a, s).otherwise(F.lit(-1e32)))


def entity_features(rows: DataFrame, most: int, length: int) -> DataFrame:
    """(id, entity_ids, positions) of up to ``most`` mentions (array of struct<entity, start, end>), places padded to ``length``; without mentions one padding entity."""
    from spanforge.functions.text import position_ids

    kept = F.slice("mentions", 1, most)
    none = F.size("mentions") == 0
    ids = F.when(none, F.array(F.lit(0))).otherwise(F.transform(kept, lambda m: m["entity"].cast("int")))
    places = F.when(none, F.array(F.array_repeat(F.lit(-1), length))).otherwise(F.transform(kept, lambda m: position_ids(m["start"], m["end"], length)))
    return rows.select("id", ids.alias("entity_ids"), places.alias("positions"))


def sided_mentions(rows: DataFrame) -> DataFrame:
    """``rows`` (question, context: mentions with start and end; context_start) with mentions: the question's that end before the context, and the context's that start behind its first place."""
    before = F.filter("question", lambda m: m["end"] < F.col("context_start"))
    behind = F.filter("context", lambda m: m["start"] > F.col("context_start"))
    return rows.withColumn("mentions", F.concat(before, behind))


def split_document(rows: DataFrame, most: int, compat: bool = False) -> DataFrame:
    """(doc, part, from, to): a document of n words in as few even parts of up to ``most`` words as it takes; a cut inside a mention (array of struct<start, end>) moves to the mention's start.

    ``compat``: a cut inside the first mention stays, as older data have it.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int")
    width = F.ceil(F.col("n") / parts).cast("int")
    movable = F.slice("mentions", 2, 1 << 30) if compat else F.col("mentions")
    cut = lambda at: F.coalesce(F.array_min(F.transform(F.filter(movable, lambda m: (m["start"] < at) & (m["end"] > at)), lambda m: m["start"].cast("int"))), at.cast("int"))
    cuts = F.transform(F.sequence(F.lit(1), parts), lambda i: F.when(i == parts, F.col("n").cast("int")).otherwise(cut(i * width)))
    both = F.arrays_zip(F.concat(F.array(F.lit(0)), cuts).alias("from"), cuts.alias("to"))
    return rows.select("doc", F.posexplode(both).alias("part", "x")).filter("x.to is not null").select("doc", "part", "x.from", "x.to")


def likely_labels(rows: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, label, probability) of rows (id, logits) whose softmax is above ``least``, names from labels (id, label)."""
    from spanforge.functions.text import softmax

    shares = rows.select("id", F.posexplode(softmax("logits")).alias("place", "probability"))
    names = labels.select(F.col("id").alias("place"), "label")
    return shares.filter(F.col("probability") > least).join(names, "place").select("id", "label", "probability")
