"""Substring deduplication (operator 11): paths of a de Bruijn graph of token k-mers, verified at source coordinates.

An edge of the graph is a window of ``length`` words in sequence, a node the run of one word less at
either end of it. Only windows that may repeat become edges: a window's anchor is the least of the
hashes of its runs of ANCHOR words, so that equal windows have equal anchors, and windows whose
anchor is in one document only are out. Windows in sequence with one anchor are a *run*, about one
for 21 words; all that moves for a document are its runs, and equal runs count as one from there on.

A run that is the only one with its anchor, whatever the number of documents that have it, is one long
edge. The windows of others are cut from the document where the run comes first; equal ones are one
edge, whose coordinates are the document with the least doc_id that has it and a place there. Edges
that other documents have too are joined to the nodes with one way in and one way out, which makes
repeated nonbranching paths; a path is a span of one document, its source. Runs then meet the paths
instead of windows, and a document's runs give its repeated spans, each with its place in the source.
A second fingerprint of the words at both coordinates has to agree, else the span is not repeated.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, sieve, sifted, text_slices, wanted
from spanforge.llm.words import _power, mix, words_of

#: Words of a window, and of the shorter runs whose hashes are its anchors.
LENGTH, ANCHOR = 50, 10
_SECOND = np.uint64(0xA0761D6478BD642F)


class Rolling:
    """Hashes of any runs of words in sequence, by prefix sums of the words' hashes."""

    def __init__(self, hashes: np.ndarray, salt: np.uint64 = np.uint64(0)):
        up, self.down = _power(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes + salt) * up[: len(hashes)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        size = np.asarray(sizes, np.int64)
        return mix((self.sums[starts + size] - self.sums[starts]) * self.down[starts] + size.astype(np.uint64))


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the leftmost place of the least one."""
    best, size = np.arange(len(values)), 1
    while size < width and len(best):
        step = min(size, width - size)
        left, right = best[:-step], best[step:]
        best = np.where(values[left] <= values[right], left, right)
        size += step
    return best


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def signed(docs: DataFrame, length: int) -> DataFrame:
    """For each row of ``docs`` (doc_id, mark, text): n_words, the digest of all its words, and its runs as four arrays (anchor, run, start, n)."""
    anchor = min(ANCHOR, length)

    def runs(hashes: np.ndarray, first: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
        windows = np.where(known, np.maximum(np.diff(first) - length + 1, 0), 0)
        offsets = np.concatenate([[0], np.cumsum(windows)])
        place = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], windows)
        row = np.repeat(np.arange(len(windows)), windows)
        if not len(place):
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2 + (np.zeros(len(windows) + 1, np.int64),)
        rolling = Rolling(hashes)
        short = rolling.spans(np.arange(len(hashes) - anchor + 1), anchor)
        own = leftmost_least(short, length - anchor + 1)[place]
        begin = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])]))
        n = np.diff(np.concatenate([begin, [len(place)]]))
        start, of = place[begin], row[begin]
        return short[own[begin]], rolling.spans(start, n + length - 1), start - first[of], n, np.searchsorted(of, np.arange(len(windows) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = part.column("text")
            words = words_of(texts)
            anchors, ids, start, n, ends = runs(words.hashes(), words.first, ~part.column("doc_id").is_null().to_numpy(zero_copy_only=False))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), c) for c in (_signed(anchors), _signed(ids), pa.array(start, pa.int32()), pa.array(n, pa.int32()))]
            digests = pa.array([_digest(t.split()) for t in texts.cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(np.diff(words.first)), digests, *lists], ["doc_id", "mark", "n_words", "whole", "anchor", "run", "start", "n"])

    return docs.mapInArrow(run, "doc_id long, mark long, n_words long, whole string, anchor array<long>, run array<long>, start array<int>, n array<int>")


def _windows(found: DataFrame, length: int) -> DataFrame:
    """``found`` (doc_id, mark, text, runs: start, n, run, last, alone) -> edges of the runs: a run that is alone with its anchor is one long edge, of any other each window is one.

    Columns: run, alone, at (the edge's place in the run), n (its windows), edge, tail and head (its
    nodes), second (another fingerprint of its windows), doc_id, place, last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words = words_of(part.column("text"))
            hashes = words.hashes()
            one, two = Rolling(hashes), Rolling(hashes, _SECOND)
            upto = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(two.spans(np.arange(max(0, len(hashes) - length + 1)), length))])
            lists = part.column("runs")
            of = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            start, n, name, last, alone = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "run", "last", "alone"))
            edges = np.where(alone, 1, n)
            ends = np.concatenate([[0], np.cumsum(edges, dtype=np.int64)])
            at = np.arange(ends[-1]) - np.repeat(ends[:-1], edges)
            size = np.repeat(np.where(alone, n, 1), edges).astype(np.int64)
            place = at + np.repeat(start, edges)
            row = np.repeat(of, edges)
            here = place + words.first[row]
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
            hashed = [_signed(x) for x in (one.spans(here, size + length - 1), one.spans(here, length - 1), one.spans(here + size, length - 1), upto[here + size] ^ upto[here])]
            columns = [pa.array(np.repeat(name, edges)), pa.array(np.repeat(alone, edges)), pa.array(at, pa.int32()), pa.array(size, pa.int32()), *hashed, pa.array(ids), pa.array(place, pa.int32()), pa.array(np.repeat(last, edges))]
            yield pa.RecordBatch.from_arrays(columns, ["run", "alone", "at", "n", "edge", "tail", "head", "second", "doc_id", "place", "last"])

    return found.mapInArrow(run, "run long, alone boolean, at int, n int, edge long, tail long, head long, second long, doc_id long, place int, last long")


def _texts_of(docs: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` that ``lists`` (doc_id, mark, ...) has a row for, each once, with its columns; a sieve spares most others the shuffle."""
    key = F.xxhash64("doc_id", "mark")
    near = sifted(docs.filter("doc_id is not null"), key, sieve(lists, key, name))
    return near.groupBy("doc_id", "mark").agg(F.first("text").alias("text")).join(lists, ["doc_id", "mark"])


def _paths(edges: DataFrame) -> DataFrame:
    """``edges`` with path: the first edge of the repeated nonbranching path that each is on.

    An edge follows on the one before it where their common node has one way in and one way out, and
    the one before it comes just before it in the same source. So a path is one span of its source.
    """
    ways = edges.select(F.col("head").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")).union(edges.select("tail", F.lit(0), F.lit(1)))
    plain = materialize(ways.groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out")).filter("into = 1 and out = 1").select(F.col("node").alias("tail"), F.lit(True).alias("plain")), "nodes")
    by = Window.partitionBy("source").orderBy("source_start")
    follows = F.col("plain") & (F.lag(F.col("source_start") + F.col("n")).over(by) == F.col("source_start")) & (F.lag("head").over(by) == F.col("tail"))
    joined = edges.join(plain, "tail", "left").withColumn("begins", ~F.coalesce(follows, F.lit(False)))
    return joined.withColumn("path", F.last(F.when(F.col("begins"), F.col("edge")), ignorenulls=True).over(by)).drop("begins", "plain")


def _spans(docs: DataFrame, sign: DataFrame, length: int) -> DataFrame:
    """doc_id, mark, start, n (windows in sequence), second, source, source_start: windows that a document with a smaller doc_id has too."""
    runs = sign.filter("doc_id is not null").select("doc_id", "mark", F.inline(F.arrays_zip("anchor", "run", "start", "n")))
    shared = materialize(runs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor"), "anchors")
    kept = materialize(runs.join(shared, "anchor", "left_semi"), "runs")
    distinct = kept.groupBy("anchor", "run").agg(F.min(F.struct("doc_id", "mark", "start")).alias("first"), F.max("doc_id").alias("last"), F.first("n").alias("n"))
    distinct = materialize(distinct.select("anchor", "run", "first.*", "last", "n"), "distinct")
    alone = materialize(distinct.groupBy("anchor").agg(F.min("run").alias("a"), F.max("run").alias("b")).filter("a = b").select("anchor", F.lit(True).alias("alone")), "alone")
    told = distinct.join(alone, "anchor", "left").withColumn("alone", F.coalesce("alone", F.lit(False))).filter("not alone or doc_id < last")
    sources = told.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n", "run", "last", "alone")).alias("runs"))
    windows = materialize(_windows(_texts_of(docs, materialize(sources, "sources"), "source_sieve").select("doc_id", "mark", "text", "runs"), length), "windows")
    # the same window may come twice in its source: which of its places counts is open
    first = [F.min_by(c, "doc_id").alias(to) for c, to in (("place", "source_start"), ("second", "second"), ("tail", "tail"), ("head", "head"))]
    edges = windows.filter("not alone").groupBy("edge").agg(F.min("doc_id").alias("source"), F.max("last").alias("last"), *first).filter("source < last")
    columns = ["edge", "source", "source_start", "second", "tail", "head"]
    long = windows.filter("alone").select("edge", F.col("doc_id").alias("source"), F.col("place").alias("source_start"), "second", "tail", "head", "n")
    edges = materialize(edges.select(*columns, F.lit(1).alias("n")).unionByName(long), "edges")
    paths = materialize(_paths(edges).select("edge", "source", "source_start", "path", "second", "n"), "paths")
    # of a run, what is on one path at one distance is in sequence
    shift = (F.col("source_start") - F.col("at")).alias("shift")
    met = windows.filter("not alone").select("run", "at", "edge").join(paths.filter("n = 1"), "edge")
    ranges = met.groupBy("run", "source", "path", shift).agg(F.min("at").alias("at"), F.count("*").cast("int").alias("windows"), F.bit_xor("second").alias("second")).drop("path")
    whole = windows.filter("alone").select("run", F.col("doc_id").alias("source"), F.col("place").alias("shift"), "at", F.col("n").alias("windows"), "second")
    found = kept.join(materialize(ranges.unionByName(whole), "ranges"), "run").filter("source < doc_id")
    return found.select("doc_id", "mark", (F.col("start") + F.col("at")).alias("start"), F.col("windows").alias("n"), "second", "source", (F.col("shift") + F.col("at")).alias("source_start"))


def repeated_spans(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """Spans of words that a document with a smaller doc_id has too: doc_id, start (of its first word), n_words, source, source_start.

    Each word of a span is in a window of ``length`` words that starts in the document ``source``,
    which is the one with the least doc_id that has it. Spans next to each other at the same distance
    from the same source are one; others may overlap. Rows as in ``dedup_substrings``.
    """
    marked = wanted(docs, {"doc_id": "long", "text": "string"}).withColumn("mark", F.xxhash64("text"))
    spans = _spans(marked, materialize(signed(marked, length), "signed"), length).distinct()
    by = Window.partitionBy("doc_id", "mark", "source", F.col("source_start") - F.col("start")).orderBy("start")
    begins = F.coalesce(F.lag(F.col("start") + F.col("n")).over(by) < F.col("start"), F.lit(True))
    grouped = spans.withColumn("part", F.when(begins, F.col("start"))).withColumn("part", F.max("part").over(by))
    ends = F.max(F.col("start") + F.col("n")) + length - 1
    return grouped.groupBy("doc_id", "mark", "source", (F.col("source_start") - F.col("start")).alias("apart"), "part").agg((ends - F.col("part")).cast("long").alias("n_words")).select("doc_id", F.col("part").cast("long").alias("start"), "n_words", "source", (F.col("part") + F.col("apart")).cast("long").alias("source_start"))


def _without(found: DataFrame, length: int) -> DataFrame:
    """``found`` (doc_id, mark, text, spans: start, n, second) -> n_removed, kept_text and its digest; a span whose windows' second fingerprint isn't the source's stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words = words_of(part.column("text"))
            two = Rolling(words.hashes(), _SECOND)
            total = len(words.starts)
            second = two.spans(np.arange(max(0, total - length + 1)), length)
            upto = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(second)])
            lists = part.column("spans")
            of = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            start, n, claimed = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "second"))
            here = start + words.first[of]
            same = (upto[here + n] ^ upto[here]).view(np.int64) == claimed
            change = np.zeros(total + 1, np.int64)
            np.add.at(change, here[same], 1)
            np.add.at(change, here[same] + n[same] + length - 1, -1)
            stays = np.cumsum(change[:-1]) == 0
            kept = []
            for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                kept.append(list(itertools.compress(text.split(), stays[words.first[i] : words.first[i + 1]].tolist())))
            removed = np.add.reduceat(np.concatenate([~stays, [False]]).astype(np.int64), words.first[:-1]) if part.num_rows else np.zeros(0, np.int64)
            removed = np.where(np.diff(words.first) > 0, removed, 0)
            texts = pa.array([b" ".join(w) for w in kept], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(removed), texts, pa.array([_digest(w) for w in kept], pa.string())], ["doc_id", "mark", "n_removed", "kept_text", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, mark long, n_removed long, kept_text string, kept_sha256 string")


def _removed(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (doc_id, mark, n_removed, kept_text, kept_sha256) for each row of ``docs`` with a repeated span."""
    sign = materialize(signed(docs, length), "signed")
    lists = _spans(docs, sign, length).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "n", "second")).alias("spans"))
    return sign, _without(_texts_of(docs, materialize(lists, "spans"), "span_sieve").select("doc_id", "mark", "text", "spans"), length)


def dedup_substrings(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed and kept_sha256.

    Words are runs of characters other than ASCII white space. A word is removed if it is in a window
    of ``length`` words whose words also start, in the same order, somewhere in a document with a
    smaller doc_id; windows are judged on the input. kept_sha256 is the hash of the words that stay,
    joined by one space. Texts that are null, empty or shorter than a window lose nothing. No doc_id
    is smaller than a null one, and a null one than none: such rows lose nothing and take nothing.
    Rows with one doc_id don't take from each other; a repeated row has the same result each time.
    Other columns are ignored; an empty table gives no rows.
    """
    marked = wanted(docs, {"doc_id": "long", "text": "string"}).withColumn("mark", F.xxhash64("text"))
    sign, removed = _removed(marked, length)
    removed = materialize(removed.drop("kept_text"), "removed")
    out = sign.select("doc_id", "mark", "n_words", "whole").join(removed, ["doc_id", "mark"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """``docs`` with all its columns, and in texts with repeated spans just the words that stay, joined by one space; other texts are as they were."""
    small = wanted(docs, {"doc_id": "long", "text": "string"}).withColumn("mark", F.xxhash64("text"))
    _, removed = _removed(small, length)
    once = materialize(removed.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("kept_text").alias("__kept")), "kept")
    rows = docs.withColumn("__own", F.col("doc_id").cast("long")).withColumn("__own_mark", F.xxhash64(F.col("text").cast("string")))
    joined = rows.join(once, (F.col("__own") == F.col("__id")) & (F.col("__own_mark") == F.col("__mark")), "left")
    return joined.select(*[F.coalesce("__kept", F.col("text").cast("string")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
