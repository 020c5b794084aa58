"""Answers from start and end scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_places(scores, k: int):
    """(place, score) of the ``k`` largest of an array, the earlier place first among equals."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("minus"), i.alias("place"), s.alias("score")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["place"].alias("place"), p["score"].alias("score")))


def best_spans(rows: DataFrame, k: int, n: int, longest: int) -> DataFrame:
    """(id, rank, start, end, score): the ``n`` best spans of up to ``longest`` places of rows (id, starts, ends), from the ``k`` best starts and ends each."""
    starts = rows.select("id", F.explode(top_places(F.col("starts"), k)).alias("s"), top_places(F.col("ends"), k).alias("e"))
    pairs = starts.select("id", "s", F.explode("e").alias("e")).select("id", F.col("s.place").alias("start"), F.col("e.place").alias("end"), (F.col("s.score") + F.col("e.score")).alias("score"))
    valid = pairs.filter((F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") < longest))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "start", "end"))
    return valid.withColumn("rank", rank).filter(F.col("rank") <= n).select("id", "rank", "start", "end", "score")


def distinct_answers(spans: DataFrame, n: int) -> DataFrame:
    """Of spans (id, text, score) the ``n`` best with different texts, as (id, rank, text, score)."""
    one = spans.groupBy("id", "text").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "text"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= n)


def with_empty(answers: DataFrame, nulls: DataFrame) -> DataFrame:
    """``answers`` (id, rank, text, score) with '' of nulls (id, null_score) behind those that lack it; an id that then has but one entry gets 'empty' of score 0 in front."""
    lacking = nulls.join(answers.filter("text = ''").select("id"), "id", "left_anti").select("id", F.lit((1 << 31) - 1).alias("rank"), F.lit("").alias("text"), F.col("null_score").alias("score"))
    both = answers.select("id", "rank", "text", "score").unionByName(lacking)
    alone = both.groupBy("id").agg(F.count("*").alias("n")).filter("n = 1").select("id", F.lit(0).alias("rank"), F.lit("empty").alias("text"), F.lit(0.0).alias("score"))
    order = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
    return both.unionByName(alone).withColumn("rank", order)


def valid_spans(spans: DataFrame, windows: DataFrame, longest: int) -> DataFrame:
    """Of ``spans`` (id, start, end) those within their window's tokens (id, in_context, max_context: flags of its tokens) that start and end in the context, start where the window has most context, and have up to ``longest`` tokens."""
    flag = lambda name, at: F.coalesce(F.get(F.col(name), F.col(at)), F.lit(False))
    rows = spans.join(windows.select("id", "in_context", "max_context"), "id")
    ok = flag("in_context", "start") & flag("in_context", "end") & flag("max_context", "start") & (F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") + 1 <= longest)
    return rows.filter(ok & (F.col("start") >= 0)).drop("in_context", "max_context")


def best_windows(rows: DataFrame, by: str, last: bool = False) -> DataFrame:
    """Of rows (by, window, score, ...) each one's best by score; of equal ones the first window, or the ``last``."""
    rest = F.struct(*[c for c in rows.columns if c != by])
    return rows.groupBy(by).agg(F.max_by(rest, F.struct("score", F.col("window") if last else -F.col("window"))).alias("x")).select(by, "x.*")


def probabilities(spans: DataFrame) -> DataFrame:
    """``spans`` (id, score) with probability, by softmax over each id's."""
    top = F.max("score").over(Window.partitionBy("id"))
    power = F.exp(F.col("score") - top)
    return spans.withColumn("probability", power / F.sum(power).over(Window.partitionBy("id")))


def null_decision(spans: DataFrame, nulls: DataFrame, threshold: float) -> DataFrame:
    """(id, start, end, gap): each id's best span, or nulls where the null score less its score is above the threshold. gap is that difference."""
    rows = spans.filter("rank = 1").join(nulls, "id").withColumn("gap", F.col("null_score") - F.col("score"))
    answer = F.col("gap") <= threshold
    return rows.select("id", F.when(answer, F.col("start")).alias("start"), F.when(answer, F.col("end")).alias("end"), "gap")
