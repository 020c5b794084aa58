"""Scores of predictions against gold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from spanforge.functions.text import answer_tokens
from spanforge.operators.ordering import in_order
from spanforge.session import keep


#: Tokens that a task counts together, but for a single longer pair.
_TOKENS = 250_000


def _shared(a: pa.Array, b: pa.Array) -> np.ndarray:
    """How many numbers the arrays of each row share, each as often as in both."""
    own = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in (a, b)]
    row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in own])
    token = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in (a, b)])
    if not len(row):
        return np.zeros(len(a), np.int32)
    order = np.lexsort((token, row))
    left = (order < own[0].sum()).astype(np.int64)
    row, token = row[order], token[order]
    starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (token[1:] != token[:-1])]))
    in_a = np.add.reduceat(left, starts)
    both = np.minimum(in_a, np.diff(np.append(starts, len(row))) - in_a)
    return np.bincount(row[starts], weights=both, minlength=len(a)).astype(np.int32)


@F.arrow_udf(IntegerType())
def _shared_hashes(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many numbers two arrays share, each as often as in both; null if one is null. Some rows are counted at a time, so that memory doesn't follow a batch's texts."""
    after = np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + b.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    out, at = [np.zeros(0, np.int32)], 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + _TOKENS, side="right")))
        out.append(_shared(a.slice(at, stop - at), b.slice(at, stop - at)))
        at = stop
    null = a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate(out), pa.int32(), mask=null)


def shared_tokens(a: Column, b: Column) -> Column:
    """How many tokens two arrays share, by 64-bit hashes, each as often as in both; null if one is null."""
    hashes = lambda tokens: F.transform(tokens, lambda t: F.xxhash64(t))
    return _shared_hashes(hashes(a), hashes(b))


def token_f1(pred: Column, gold: Column, empty_counts: bool = False) -> Column:
    """F1 of token arrays, 0 without overlap; ``empty_counts``: if one is empty, whether both are."""
    same = shared_tokens(pred, gold)
    f1 = F.when(same > 0, 2.0 * same / (F.size(pred) + F.size(gold))).otherwise(0.0)
    if not empty_counts:
        return f1
    return F.when((F.size(pred) == 0) | (F.size(gold) == 0), (F.size(pred) == F.size(gold)).cast("double")).otherwise(f1)


def answer_scores(pred: DataFrame, gold: DataFrame, language: str = "en", empty_counts: bool = False, unicode_marks: bool | None = None) -> DataFrame:
    """(qid, exact, f1, answered): the best over the gold answers (qid, answer) of each question, for pred (qid, text); unanswered ones have 0."""
    rows = gold.join(pred, "qid", "left").withColumn("p", answer_tokens("text", language, unicode_marks)).withColumn("g", answer_tokens("answer", language, unicode_marks))
    exact, f1 = (F.array_join("p", " ") == F.array_join("g", " ")).cast("double"), token_f1(F.col("p"), F.col("g"), empty_counts)
    rows = rows.select("qid", F.coalesce(exact, F.lit(0.0)).alias("exact"), F.coalesce(F.when(F.col("text").isNotNull(), f1), F.lit(0.0)).alias("f1"), F.col("text").isNotNull().alias("answered"))
    return rows.groupBy("qid").agg(F.max("exact").alias("exact"), F.max("f1").alias("f1"), F.max("answered").alias("answered"))


def usable_gold(gold: DataFrame, language: str = "en") -> DataFrame:
    """The answers of gold (qid, answer) whose normal form isn't empty; a question without any has ''."""
    some = gold.filter(F.size(answer_tokens("answer", language)) > 0).select("qid", "answer")
    none = gold.select("qid").distinct().join(some.select("qid"), "qid", "left_anti").withColumn("answer", F.lit(""))
    return some.unionByName(none)


def corpus_scores(scores: DataFrame, unanswered: bool) -> DataFrame:
    """(exact_match, f1, total) in percent; ``unanswered``: whether questions without a prediction count."""
    rows = scores if unanswered else scores.filter("answered")
    return rows.agg((100 * F.coalesce(F.avg("exact"), F.lit(0.0))).alias("exact_match"), (100 * F.coalesce(F.avg("f1"), F.lit(0.0))).alias("f1"), F.count("*").alias("total"))


def with_threshold(scores: DataFrame, threshold: float) -> DataFrame:
    """``scores`` (qid, exact, f1, has_ans, na_prob): where na_prob is above the threshold, the score says whether there is no answer."""
    none = F.when(F.col("has_ans"), 0.0).otherwise(1.0)
    above = F.col("na_prob") > threshold
    return scores.withColumn("exact", F.when(above, none).otherwise(F.col("exact"))).withColumn("f1", F.when(above, none).otherwise(F.col("f1")))


def grouped_scores(scores: DataFrame) -> DataFrame:
    """One row: exact, f1 and total of all questions, those with and those without an answer."""
    parts = []
    for name, which in (("", F.lit(True)), ("has_ans_", F.col("has_ans")), ("no_ans_", ~F.col("has_ans"))):
        parts += [(100 * F.avg(F.when(which, F.col(c)))).alias(f"{name}{c}") for c in ("exact", "f1")] + [F.count(F.when(which, 1)).alias(f"{name}total")]
    return scores.agg(*parts)


def best_threshold(scores: DataFrame, value: str) -> DataFrame:
    """(best_score, best_threshold): the na_prob up to which answering gives the largest mean ``value``; 0 if never answering is best.

    Sorted by na_prob, the running sum starts at the number without answer, gains an answer's
    score, and loses 1 where a question without one would be answered with something.
    """
    gain = F.when(F.col("has_ans"), F.col(value)).otherwise(F.when(F.col("answer_given"), -1.0).otherwise(0.0))
    steps = in_order(scores.select("na_prob", "qid", "has_ans", gain.alias("gain")), "na_prob", "qid", place="rn", sums={"run": F.col("gain")})
    base = steps.agg(F.sum((~F.col("has_ans")).cast("double")).alias("base"), F.count("*").alias("n"))
    top = steps.agg(F.max_by(F.struct("run", "na_prob"), F.struct(F.round("run", 9), -F.col("rn"))).alias("top"))
    joined = base.crossJoin(top)  # one row each
    better = F.col("top.run") > 0
    return joined.select((100 * (F.col("base") + F.when(better, F.col("top.run")).otherwise(0.0)) / F.col("n")).alias("best_score"), F.when(better, F.col("top.na_prob")).otherwise(0.0).alias("best_threshold"))


def best_thresholds(scores: DataFrame) -> DataFrame:
    """One row: best_exact, best_exact_thresh, best_f1, best_f1_thresh, and has_ans_exact and has_ans_f1, the means of questions with an answer."""
    scores = keep(scores.select("qid", "exact", "f1", "has_ans", "na_prob", "answer_given"), "scores")
    one = lambda v: best_threshold(scores, v).select(F.col("best_score").alias(f"best_{v}"), F.col("best_threshold").alias(f"best_{v}_thresh"))
    has = scores.agg(*[F.avg(F.when(F.col("has_ans"), F.col(v))).alias(f"has_ans_{v}") for v in ("exact", "f1")])
    return one("exact").crossJoin(one("f1")).crossJoin(has)  # one row each


def _steps(scores: DataFrame, value: str) -> DataFrame:
    """(na_prob, hits, n, wanted, true, seen): sums at each distinct na_prob, and up to it."""
    hit = F.when(F.col("has_ans"), F.col(value)).otherwise(0.0)
    steps = scores.groupBy("na_prob").agg(F.sum(hit).alias("hits"), F.count("*").alias("n"), F.sum(F.col("has_ans").cast("int")).alias("wanted"))
    return in_order(steps, "na_prob", sums={"true": F.col("hits"), "seen": F.col("n")})


def precision_curve(scores: DataFrame, value: str) -> DataFrame:
    """(na_prob, precision, recall) at each distinct na_prob, for answering up to it."""
    run = _steps(scores, value)
    all_wanted = run.agg(F.sum("wanted").alias("all"))
    return run.crossJoin(all_wanted).select("na_prob", (F.col("true") / F.col("seen")).alias("precision"), (F.col("true") / F.col("all")).alias("recall"))  # one row


def oracle_precision(scores: DataFrame) -> DataFrame:
    """(ap) of telling questions with an answer from the others by na_prob."""
    return average_precision(scores.withColumn("__has", F.col("has_ans").cast("double")), "__has")


def average_precision(scores: DataFrame, value: str) -> DataFrame:
    """(ap): precision and recall along rising na_prob, taken where the next na_prob differs."""
    # a step's recall is its hits' share: precision goes by all up to it
    return _steps(scores, value).agg((100 * F.sum(F.col("true") / F.col("seen") * F.col("hits")) / F.sum("wanted")).alias("ap"))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def label_scores(rows: DataFrame, ignored: list[str] = ()) -> DataFrame:
    """(label, correct, n_gold, n_pred, precision, recall, f1) from rows (gold, pred); directions at a label's end, like (e1,e2), don't part labels but must be right."""
    plain = lambda c: F.regexp_replace(c, r"\(e[12],e[12]\)$", "")
    hits = rows.select(F.explode(F.array(F.struct(plain("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col("gold") == F.col("pred")).cast("int").alias("c")), F.struct(plain("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("c")))).alias("x")).select("x.*")
    by = hits.groupBy("label").agg(F.sum("c").alias("correct"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred")).filter(~F.col("label").isin(*ignored) if ignored else F.lit(True))
    p, r = _ratio(F.col("correct"), F.col("n_pred")), _ratio(F.col("correct"), F.col("n_gold"))
    return by.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def multiway_f1(rows: DataFrame, ignored: list[str] = ()) -> DataFrame:
    """(macro_f1, micro_f1): the plain mean over the labels seen, and F1 of their sums."""
    by = label_scores(rows, ignored).agg(F.avg("f1").alias("macro_f1"), F.sum("correct").alias("c"), F.sum("n_pred").alias("p"), F.sum("n_gold").alias("g"))
    return by.select("macro_f1", _f1(_ratio(F.col("c"), F.col("p")), _ratio(F.col("c"), F.col("g"))).alias("micro_f1"))


def micro_f1(rows: DataFrame, negative: str) -> DataFrame:
    """(precision, recall, f1) from rows (gold, pred), where ``negative`` is no class to find."""
    right = F.sum(((F.col("gold") == F.col("pred")) & (F.col("pred") != negative)).cast("int"))
    sums = rows.agg(right.alias("c"), F.sum((F.col("pred") != negative).cast("int")).alias("p"), F.sum((F.col("gold") != negative).cast("int")).alias("g"))
    return _prf(sums)


def _prf(sums: DataFrame) -> DataFrame:
    rows = sums.select(_ratio(F.col("c"), F.col("p")).alias("precision"), _ratio(F.col("c"), F.col("g")).alias("recall"))
    return rows.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def accuracy(rows: DataFrame, ignored: str) -> DataFrame:
    """(accuracy): all equal pairs over those whose gold isn't ``ignored``."""
    return rows.agg(_ratio(F.sum((F.col("gold") == F.col("pred")).cast("int")), F.sum((F.col("gold") != ignored).cast("int"))).alias("accuracy"))


def multilabel_f1(rows: DataFrame) -> DataFrame:
    """(precision, recall, f1) from arrays of labels (gold, pred)."""
    return _prf(rows.agg(F.sum(F.size(F.array_intersect("gold", "pred"))).alias("c"), F.sum(F.size("pred")).alias("p"), F.sum(F.size("gold")).alias("g")))


def disambiguation_prf(rows: DataFrame) -> DataFrame:
    """(precision, recall, f1) from (gold, pred, has_candidates): precision over mentions with candidates, recall over all."""
    right = F.sum(((F.col("gold") == F.col("pred")) & F.col("has_candidates")).cast("int"))
    return _prf(rows.agg(right.alias("c"), F.sum(F.col("has_candidates").cast("int")).alias("p"), F.count("*").alias("g")))


def span_f1(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(precision, recall, f1) of sets of spans with equal ``keys``."""
    p, g = pred.select(*keys).distinct(), gold.select(*keys).distinct()
    both = p.withColumn("p", F.lit(1)).join(g.withColumn("g", F.lit(1)), keys, "full_outer")
    return _prf(both.agg(F.coalesce(F.sum(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)), F.lit(0)).alias("c"), F.count("p").alias("p"), F.count("g").alias("g")))


def running_mean(rows: DataFrame, order: str, value: str, by: str | None = None) -> DataFrame:
    """(by, order, mean): the mean of all values up to each row."""
    if by is None:
        steps = in_order(rows.select(order, value), order, sums={"__sum": F.col(value), "__n": F.col(value).isNotNull().cast("long")})
        return steps.select(order, (F.col("__sum") / F.when(F.col("__n") > 0, F.col("__n"))).alias("mean"))
    over = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(by, order, F.avg(value).over(over).alias("mean"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) of values from 0 to 1 (exclusive) in equal bins."""
    return rows.groupBy(F.floor(F.col(value) * bins).alias("bin")).agg(F.count("*").alias("n"))
