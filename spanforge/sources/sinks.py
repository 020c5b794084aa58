"""Writers; each takes a folder and leaves Spark's part files there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Lines {id, entities: [[title, lang]], count}, an entity's titles together."""
    lang = F.col("lang") if "lang" in vocab.columns else F.lit(None).cast("string")
    rows = vocab.groupBy("id").agg(F.array_sort(F.collect_list(F.array("title", lang))).alias("entities"), F.max("count").alias("count"))
    rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_lookup(rows: DataFrame, path: str, key: str) -> None:
    """A table to look up by ``key``: ranges of it in files, sorted, so that a lookup reads few row groups."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_buckets(rows: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    """A table ``name`` under ``path`` to look up and join by ``key``: in buckets of it, sorted, with a Bloom filter of the keys in each file.

    Joins by key leave such a table where it is: only the other side is shuffled, and two tables of
    as many buckets are not shuffled at all. A search for single keys reads one bucket, and of that
    only row groups whose filter may hold them. Choose buckets of some hundred MB each.
    """
    writer = rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    writer.option("path", path).option(f"parquet.bloom.filter.enabled#{key}", "true").saveAsTable(name)


def write_lines(rows: DataFrame, path: str, *columns: str) -> None:
    rows.select(F.concat_ws("\t", *columns).alias("value")).write.mode("overwrite").text(path)


def write_examples(examples: DataFrame, path: str, properties: dict) -> None:
    """Examples as Parquet under examples, their number and ``properties`` as one JSON line under metadata."""
    examples.write.mode("overwrite").parquet(f"{path}/examples")
    n = examples.sparkSession.read.parquet(f"{path}/examples").agg(F.count("*").alias("number_of_items"))
    n.select("number_of_items", *[F.lit(v).alias(k) for k, v in properties.items()]).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_predictions(rows: DataFrame, path: str) -> None:
    """Lines {id, ...} of predictions, n-best lists or null scores."""
    rows.write.mode("overwrite").json(path)


def write_bio(lines: DataFrame, path: str) -> None:
    """Lines (file, line, text) of five fields by spaces with their last one, the label, in BIO form: after O or at a sentence's start a tag becomes B-."""
    upto = Window.partitionBy("file").orderBy("line")
    label = F.element_at(F.split(F.trim("text"), " "), -1)
    blank = F.trim("text") == ""
    rows = lines.withColumn("__label", F.when(~blank, label)).withColumn("__before", F.lag("__label").over(upto))
    starts = ~blank & (F.col("__label") != "O") & (F.col("__before").isNull() | (F.col("__before") == "O"))
    text = F.when(starts, F.concat(F.regexp_replace("text", r"\S+\s*$", ""), F.lit("B-"), F.substring("__label", 3, 1 << 20))).otherwise(F.col("text"))
    out = rows.select("file", "line", text.alias("value"))
    out.repartition("file").sortWithinPartitions("file", "line").select("value").write.mode("overwrite").text(path)


def write_tag_lists(sentences: DataFrame, path: str) -> None:
    """``write_tags`` of sentences (sentence, lines: array of "word gold pred" in order), a row each: only they are shuffled, a text each. Those without lines are left out."""
    text = F.concat(F.array_join("lines", "\n"), F.lit("\n"))
    # by explode, so that the text is put together once, and no filter on it goes before the shuffle
    out = sentences.select("sentence", F.explode(F.filter(F.array(text), lambda x: x != "\n")).alias("value"))
    out.repartitionByRange("sentence").sortWithinPartitions("sentence").select("value").write.mode("overwrite").text(path)


def write_tags(rows: DataFrame, path: str) -> None:
    """Lines "word gold pred" of rows (sentence, pos, word, gold, pred) in order, an empty one behind each sentence."""
    line = F.struct("pos", F.concat_ws(" ", "word", "gold", "pred").alias("line"))
    lists = rows.groupBy("sentence").agg(F.array_sort(F.collect_list(line)).alias("all"))
    write_tag_lists(lists.select("sentence", F.col("all.line").alias("lines")), path)
