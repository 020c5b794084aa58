"""Windows over word sequences: strides, contexts, spans, and what lies inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.ordering import in_order

#: Words whose spans a task makes at a time, but for the words of a single longer sentence, which are only counted together.
_WORDS = 20_000


def stride_starts(n: Column | str, length: int, stride: int) -> Column:
    """Starts of windows of ``length`` over n words, ``stride`` apart; the last is the first that reaches the end."""
    n = F.col(n) if isinstance(n, str) else n
    count = F.greatest(F.lit(1), F.ceil((n - length) / F.lit(stride)) + 1)
    return F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: i * stride)


def stride_windows(docs: DataFrame, length: int, stride: int) -> DataFrame:
    """(doc_id, window, start, size) over docs (doc_id, n); no words give one empty window."""
    rows = docs.select("doc_id", "n", F.posexplode(stride_starts("n", length, stride)).alias("window", "start"))
    return rows.select("doc_id", "window", "start", F.least(F.lit(length), F.col("n") - F.col("start")).cast("int").alias("size"))


def max_context(windows: DataFrame) -> DataFrame:
    """(doc_id, word, window): the window where each word has most context, from (doc_id, window, start, size).

    A word's score is the smaller of its contexts left and right plus a hundredth of the window's
    size; the first window wins ties. Only windows are shuffled: a document's go by in order, and
    words come from a window once no later one can hold them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, best, own, at = None, np.zeros(0), np.zeros(0, np.int32), 0  # scores and windows of words from ``at`` on
        out: list[tuple] = []
        held = 0

        def told() -> pa.RecordBatch:
            n = [len(x[2]) for x in out]
            docs = pa.array([x[0] for x in out], kinds_[0]).take(pa.array(np.repeat(np.arange(len(out)), n)))
            words = np.concatenate([np.arange(x[1], x[1] + len(x[2])) for x in out])
            keep = np.concatenate([x[2] for x in out])
            there = keep >= 0
            return pa.RecordBatch.from_arrays([docs.filter(pa.array(there)), pa.array(words[there].astype(np.int32)), pa.array(keep[there].astype(np.int32))], ["doc_id", "word", "window"])

        for batch in batches:
            kinds_ = [batch.column("doc_id").type]
            for d, window, start, size in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "window", "start", "size")], strict=True):
                if d != doc or start > at + len(own):
                    out.append((doc, at, own))
                    held += len(own)
                    doc, at, best, own = d, start, np.zeros(0), np.zeros(0, np.int32)
                elif start > at:
                    out.append((doc, at, own[: start - at]))
                    held += start - at
                    best, own, at = best[start - at :], own[start - at :], start
                more = max(0, size - len(own))
                best, own = np.append(best, np.full(more, -np.inf)), np.append(own, np.full(more, -1, np.int32))
                left = np.arange(size)
                score = np.minimum(left, size - 1 - left) + 0.01 * size
                better = (score > best[:size]) | ((score == best[:size]) & (window < own[:size]))
                best[:size][better], own[:size][better] = score[better], window
                if held > _WORDS:
                    yield told()
                    out, held = [], 0
        if len(own):
            out.append((doc, at, own))
        if out:
            yield told()

    kinds = dict(windows.dtypes)
    ordered = windows.filter("size > 0").select("doc_id", "window", "start", "size").repartition("doc_id").sortWithinPartitions("doc_id", "start", "window")
    return ordered.mapInArrow(run, f"doc_id {kinds['doc_id']}, word int, window int")


def centred_context(sentences: DataFrame, most: int) -> DataFrame:
    """(doc_id, sentence, left, right): words taken before and after each sentence (doc_id, sentence, start, end, n) of a document of n words, ``most`` in all, as evenly as the document allows."""
    room = F.greatest(F.lit(0), F.lit(most) - (F.col("end") - F.col("start")))
    left_all, right_all = F.col("start"), F.col("n") - F.col("end")
    half = F.floor(room / 2)
    left = F.when(left_all < right_all, F.least(left_all, half)).otherwise(F.least(left_all, room - F.least(right_all, half)))
    rows = sentences.withColumn("left", left.cast("int"))
    return rows.select("doc_id", "sentence", "left", F.least(right_all, room - F.col("left")).cast("int").alias("right"))


def spans(sentences: DataFrame, longest: int) -> DataFrame:
    """(doc_id, sentence, start, end): all spans of up to ``longest`` words of each sentence (doc_id, sentence, n)."""
    # not as a filter, which Spark would move below the words' count and count twice
    words = F.when(F.col("n") > 0, F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))
    starts = sentences.select("doc_id", "sentence", "n", F.explode(words).alias("start"))
    return starts.select("doc_id", "sentence", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("n").cast("int"), F.col("start") + longest))).alias("end"))


def word_spans(sentences: DataFrame, longest: int, most: int) -> DataFrame:
    """(doc_id, sentence, start, end, first, last, chunk) of sentences (doc_id, sentence, sizes: subwords of each word): all spans of whole words with up to ``longest`` subwords, in as few even chunks of up to ``most`` as it takes.

    start and end count subwords, first and last (exclusive) words; each word has one subword at least.
    A sentence stays whole in its task, so that nothing is shuffled. Spans are made for some
    sentences at a time, and of a long one in parts of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sizes")
            own = lists.fill_null([]).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            after = np.cumsum(own)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + _WORDS, side="right")))
                low, counts = int(after[at] - own[at]), own[at:stop]
                sums = np.concatenate([[0], np.cumsum(flat[low : after[stop - 1]])])
                row = np.repeat(np.arange(len(counts)), counts)
                begin = np.repeat(np.cumsum(counts) - counts, counts)  # of each word its sentence's first word
                limit = np.repeat(np.cumsum(counts), counts)
                words = np.arange(len(row))
                # how many spans begin at each word: sums rise, as each word has a subword at least
                until = np.minimum(np.minimum(np.searchsorted(sums, sums[words] + longest, side="right") - 1, words + longest), limit)
                spans = np.maximum(until - words, 0)
                n = np.bincount(row, weights=spans, minlength=len(counts)).astype(np.int64)
                width = np.ceil(n / np.ceil(n / most, where=n > 0, out=np.ones(len(n)))).astype(np.int64)
                before = np.cumsum(spans) - spans  # of each word the spans before it
                rank = before - np.repeat((np.cumsum(n) - n), counts)  # in its sentence
                for i in range(0, len(words), _WORDS):
                    own_spans = spans[i : i + _WORDS]
                    first = np.repeat(words[i : i + _WORDS], own_spans)
                    if not len(first):
                        continue
                    nth = np.arange(len(first)) - np.repeat(np.cumsum(own_spans) - own_spans, own_spans)
                    last, r = first + nth + 1, row[first]
                    zero = begin[first]
                    base = sums[zero]
                    columns = [sums[first] - base, sums[last] - base, first - zero, last - zero, (rank[first] + nth) // np.maximum(width[r], 1)]
                    keys = [batch.column(c).take(pa.array(r + at)) for c in ("doc_id", "sentence")]
                    yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c.astype(np.int32)) for c in columns]], ["doc_id", "sentence", "start", "end", "first", "last", "chunk"])
                at = stop

    kinds = dict(sentences.dtypes)
    rows = sentences.select("doc_id", "sentence", F.col("sizes").cast("array<int>").alias("sizes"))
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, sentence {kinds['sentence']}, start int, end int, first int, last int, chunk int")


def numbered_windows(rows: DataFrame, *by: str, first: int = 1_000_000_000) -> DataFrame:
    """``rows`` with unique_id, counted from ``first`` in the order of ``by``."""
    return in_order(rows, *by, place="unique_id").withColumn("unique_id", F.col("unique_id") + first)


def inside(windows: DataFrame, things: DataFrame, keys: list[str]) -> DataFrame:
    """``things`` (keys, start, end) whole inside ``windows`` (keys, window, w_start, w_end), with places from the window's start on."""
    rows = things.join(windows, keys).filter((F.col("start") >= F.col("w_start")) & (F.col("end") <= F.col("w_end")))
    return rows.withColumn("start", F.col("start") - F.col("w_start")).withColumn("end", F.col("end") - F.col("w_start")).drop("w_start", "w_end")


def offsets(pieces: DataFrame, by: str, order: str, size: str) -> DataFrame:
    """``pieces`` with offset: the sizes before each, in order within ``by``."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def char_words(docs: DataFrame) -> DataFrame:
    """(doc_id, chars): for each character of a text the number of its word, white space belonging to the word before; -1 before the first."""
    blank = r" \t\r\n\x{202F}"
    lead = F.length(F.regexp_extract("text", f"^[{blank}]*", 0))
    words = F.regexp_extract_all("text", F.lit(f"[^{blank}]+[{blank}]*"), F.lit(0))
    return docs.select("doc_id", F.concat(F.array_repeat(F.lit(-1), lead), F.flatten(F.transform(words, lambda w, i: F.array_repeat(i, F.length(w))))).alias("chars"))
