"""LM scoring (operator 7): bigram counts in a log-frequency Bloom filter, unigram counts exactly.

A pair of words with count c lies in the filter with levels 1 .. 1 + floor(log_B c); its level is
read back by probing 1, 2, ... until a level is missing, and stands for the least count that has
it. The probability of a word w after h is (c'(h w) + BETA * p(w)) / (c(h) + BETA), with p the
add-0.1 unigram probability, so that it never exceeds what exact counts would give but for the
filter's rare false hits.

Counting: tasks pre-aggregate word hashes and send them, sorted and packed by segment of the hash
space, to the task that merges a segment: it keeps the exact unigram counts and sets the bits of the
segment's own filter. Scoring: if all segments together are within ``broadcast_bytes``, they are
broadcast. Beyond that nothing is: documents are dealt to buckets, a bucket's distinct hashes go to
the segments, whose answers, in the order of the hashes, meet the bucket's documents; the scores are
the same. Messages go to groups of neighbouring segments: their number is that of tasks or buckets
times that of segments, so that with many segments of their own they would be many and tiny.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, text_slices, wanted
from spanforge.llm.words import mix, words_of

FOLDS = 10
B, BETA = 1.5, 400.0
BITS, PROBES = 10, 6
SEGMENT_BYTES, BROADCAST_BYTES = 4 << 20, 192 << 20
_FLUSH = 1_000_000
#: As powers of two: up to so many groups have one segment each, and buckets the texts of one; a group has so many segments at most, and a bucket the texts of so many.
LEAST_GROUPS, GROUP, BUCKET = 6, 4, 2
_C = np.uint64(0x9E3779B97F4A7C15)
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
UNIGRAM, BIGRAM = 0, 1
LEAST_OF_LEVEL = np.array([0] + [math.ceil(round(B ** (j - 1), 9)) for j in range(1, 110)], np.float64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words, A-Z lower-cased, and one end after each; and the texts' offsets."""
    words = words_of(texts, lower=True)
    count = np.diff(words.first)
    offsets = np.concatenate([[0], np.cumsum(count + 1)])
    out = np.full(offsets[-1], END, np.uint64)
    out[np.arange(len(words.starts)) + words.row_of()] = words.hashes()
    return out, offsets


def pairs(toks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's predecessor (START for a text's first), and the hash of both."""
    before = np.concatenate([[START], toks[:-1]])
    before[offsets[:-1]] = START
    return before, mix(before * _C + mix(toks))


def pack(values: np.ndarray) -> bytes:
    """Bytes of a numeric array, byte planes apart, deflated: sorted hashes of one segment share their high bytes."""
    return zlib.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def unpack(raw: bytes, dtype: type) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(raw), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(width, len(flat) // width).T).view(dtype).ravel()


def group_bits(segment_bits: int) -> int:
    """Leading bits of a hash that tell its group of segments."""
    return max(min(segment_bits, LEAST_GROUPS), segment_bits - GROUP)


def _by_segment(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(segment, start, stop) of sorted ``keys``; with fewer ``bits`` groups of segments."""
    if not len(keys):
        return []
    segment = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(keys)]])
    return [(int(segment[a]), int(a), int(b)) for a, b in itertools.pairwise(cut)]


class Filter:
    """Log-frequency Bloom filters by segment. starts: each segment's first bit, sizes: its bits (0: no such segment), bits: all of them, packed."""

    def __init__(self, segment_bits: int, starts: np.ndarray, sizes: np.ndarray, bits: np.ndarray):
        self.shift, self.starts, self.sizes, self.bits = np.uint64(64 - segment_bits), starts, sizes, bits

    @classmethod
    def single(cls, segment_bits: int, segment: int, raw: bytes) -> Filter:
        sizes = np.zeros(1 << segment_bits, np.uint64)
        sizes[segment] = len(raw) * 8
        return cls(segment_bits, np.zeros_like(sizes), sizes, np.frombuffer(raw, np.uint8))

    @classmethod
    def several(cls, segment_bits: int, raw: dict[int, bytes]) -> Filter:
        starts, sizes = np.zeros((2, 1 << segment_bits), np.uint64)
        at = 0
        for segment, data in raw.items():
            starts[segment], sizes[segment] = at * 8, len(data) * 8
            at += len(data)
        return cls(segment_bits, starts, sizes, np.frombuffer(b"".join(raw.values()), np.uint8))

    @staticmethod
    def places(keys: np.ndarray, level: int, sizes: np.ndarray, probe: int) -> np.ndarray:
        mixed = mix(keys + np.full(1, level, np.uint64) * _C)
        return ((mixed >> np.uint64(32)) + np.uint64(probe) * ((mixed & np.uint64(0xFFFFFFFF)) | np.uint64(1))) % sizes

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray) -> bytes:
        levels = (1 + np.floor(np.log(counts) / math.log(B) + 1e-9)).astype(np.int64)
        size = max(1, -(-int(levels.sum()) * BITS // 8)) * 8
        bits, sizes = np.zeros(size, bool), np.uint64(size)
        for level in range(1, int(levels.max(initial=0)) + 1):
            own = keys[levels >= level]
            for probe in range(PROBES):
                bits[Filter.places(own, level, sizes, probe)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def levels(self, keys: np.ndarray) -> np.ndarray:
        segment = (keys >> self.shift).astype(np.int64) if self.shift < 64 else np.zeros(len(keys), np.int64)
        out = np.zeros(len(keys), np.int64)
        left = np.flatnonzero(self.sizes[segment] > 0)
        level = 0
        while len(left) and level < len(LEAST_OF_LEVEL) - 1:
            level += 1
            for probe in range(PROBES):
                s = segment[left]
                place = self.starts[s] + self.places(keys[left], level, self.sizes[s], probe)
                left = left[(self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            out[left] = level
        return out


class Exact:
    """Sorted hashes with their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0).astype(np.float64)


def count_ngrams(docs: DataFrame, segment_bits: int) -> DataFrame:
    """(kind, segment, keys, data, distinct, total): a row for each kind of n-gram and segment; data: packed counts of words, filter of pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for kind in (UNIGRAM, BIGRAM):
                keys, n = np.unique(np.concatenate(held[kind]), return_counts=True) if held[kind] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                rows += [(kind, g, pack(keys[a:b]), pack(n[a:b].astype(np.uint32))) for g, a, b in _by_segment(keys, group_bits(segment_bits))]
                held[kind].clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "group", "keys", "counts"])

        for part in text_slices(batches):
            toks, offsets = tokens(part.column("text"))
            held[UNIGRAM].append(toks)
            held[BIGRAM].append(pairs(toks, offsets)[1])
            if sum(map(len, held[UNIGRAM])) >= _FLUSH:
                yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for (kind, _), group in itertools.groupby(rows, lambda r: r[:2]):
            parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for _, _, k, c in group:
                own, n = unpack(k, np.uint64), unpack(c, np.uint32)
                for segment, a, b in _by_segment(own, segment_bits):
                    parts.setdefault(segment, []).append((own[a:b], n[a:b]))
            for segment in sorted(parts):
                own = parts.pop(segment)
                keys, place = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([c for _, c in own])).astype(np.int64)
                data = Filter.build(keys, counts) if kind == BIGRAM else pack(counts)
                row = {"kind": kind, "segment": segment, "keys": None if kind == BIGRAM else pack(keys), "data": data, "distinct": len(keys), "total": int(counts.sum())}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("kind", pa.int32()), ("segment", pa.int32()), ("keys", pa.binary()), ("data", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64())]))

    packed = docs.select("text").mapInArrow(count, "kind int, group int, keys binary, counts binary")
    packed = packed.repartition("kind", "group").sortWithinPartitions("kind", "group")
    return materialize(packed.mapInArrow(merge, "kind int, segment int, keys binary, data binary, distinct long, total long"), "lm-counts")


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(part: pa.RecordBatch, read: tuple[np.ndarray, np.ndarray], exact: Callable, pair_levels: Callable, total: int, distinct: int, beta: float) -> pa.RecordBatch:
    """``part`` scored; read: its ``tokens``."""
    toks, offsets = read
    before, both = pairs(toks, offsets)
    distinct_toks, place = np.unique(np.concatenate([toks, np.where(before == START, END, before)]), return_inverse=True)
    counts = exact(distinct_toks)[place]  # as many texts begin as end
    c, context = counts[: len(toks)], counts[len(toks) :]
    distinct_pairs, at = np.unique(both, return_inverse=True)
    joint = LEAST_OF_LEVEL[pair_levels(distinct_pairs)][at]
    base = (c + 0.1) / (total + 0.1 * (distinct + 1))
    # a false hit can't take a pair above its context
    model = (np.minimum(joint, context) + beta * base) / (context + beta)
    start = offsets[:-1]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(offsets)), pa.array(np.add.reduceat((c > 0).astype(np.int64), start)), pa.array(np.full(len(start), total)), pa.array(np.add.reduceat(np.log10(base), start)), pa.array(np.add.reduceat(np.log10(model), start))],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def _assembled(counts: DataFrame, segment_bits: int, total: int) -> tuple[np.ndarray, ...]:
    """Sorted word hashes, their counts, and the filter's starts, sizes and bits, put in place segment by segment."""
    lengths = np.zeros((2, 1 << segment_bits), np.int64)
    for r in counts.select("kind", "segment", F.when(F.col("kind") == BIGRAM, F.octet_length("data")).otherwise(F.col("distinct")).alias("n")).collect():  # a few numbers for each segment
        lengths[r.kind, r.segment] = r.n
    ends = np.cumsum(lengths, axis=1)
    # no count is above the sum of all
    keys, found, bits = np.empty(ends[UNIGRAM][-1], np.uint64), np.empty(ends[UNIGRAM][-1], np.uint32 if total < 1 << 32 else np.uint64), np.empty(max(1, ends[BIGRAM][-1]), np.uint8)
    for r in counts.select("kind", "segment", "keys", "data").toLocalIterator():
        at = slice(ends[r.kind][r.segment] - lengths[r.kind][r.segment], ends[r.kind][r.segment])
        if r.kind == BIGRAM:
            bits[at] = np.frombuffer(r.data, np.uint8)
        else:
            keys[at], found[at] = unpack(r.keys, np.uint64), unpack(r.data, np.int64)
    return keys, found, ((ends - lengths)[BIGRAM] * 8).astype(np.uint64), (lengths[BIGRAM] * 8).astype(np.uint64), bits


def _broadcast_scores(docs: DataFrame, counts: DataFrame, segment_bits: int, total: int, distinct: int, beta: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(_assembled(counts, segment_bits, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, starts, sizes, bits = sent.value
        exact, pair = Exact(keys, found), Filter(segment_bits, starts, sizes, bits)
        for part in text_slices(batches):
            yield _score(part, tokens(part.column("text")), exact, pair.levels, total, distinct, beta)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, RESULT)


def _distinct(read: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Distinct hashes of words and of pairs, sorted; the end is among the words."""
    words, both = [np.array([END])], [np.zeros(0, np.uint64)]
    for toks, offsets in read:
        words.append(toks)
        both.append(pairs(toks, offsets)[1])
    return [np.unique(np.concatenate(x)) for x in (words, both)]


def _shuffled_scores(docs: DataFrame, counts: DataFrame, segment_bits: int, buckets: int, total: int, distinct: int, beta: float) -> DataFrame:
    # a bucket asks for a word once, however often it occurs: segments get a share of distinct hashes each, frequent words or not
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    bits = group_bits(segment_bits)
    counts = counts.withColumn("group", F.shiftright("segment", segment_bits - bits))
    kinds = {UNIGRAM: np.int64, BIGRAM: np.uint8}

    def slices(texts: pa.Table) -> Iterator[pa.RecordBatch]:
        return text_slices(iter(texts.select(["doc_id", "held_out", "text"]).combine_chunks().to_batches()))

    def ask(left: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            bucket = left.column("bucket")[0].as_py()
            for kind, keys in enumerate(_distinct([tokens(part.column("text")) for part in slices(left)])):
                rows += [(kind, g, bucket, pack(keys[a:b])) for g, a, b in _by_segment(keys, bits)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["kind", "group", "bucket", "keys"])

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        rows = []
        if asked.num_rows:
            kind = asked.column("kind")[0].as_py()
            segments = sorted(table.to_pylist(), key=lambda r: r["segment"])
            if kind == BIGRAM:
                look = Filter.several(segment_bits, {r["segment"]: r["data"] for r in segments}).levels
            else:
                none = np.zeros(0, np.uint64)
                look = Exact(np.concatenate([none, *[unpack(r["keys"], np.uint64) for r in segments]]), np.concatenate([none.view(np.int64), *[unpack(r["data"], np.int64) for r in segments]]))
            for group, bucket, keys in zip(*[asked.column(c).to_pylist() for c in ("group", "bucket", "keys")], strict=True):
                rows.append((bucket, kind, group, pack(look(unpack(keys, np.uint64)).astype(kinds[kind]))))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "group", "found"])

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts = list(slices(texts))
        read = [tokens(part.column("text")) for part in parts]
        told = sorted(answers.to_pylist(), key=lambda a: a["group"])
        look = []
        for (kind, dtype), keys in zip(kinds.items(), _distinct(read), strict=True):
            found = np.concatenate([np.zeros(0, dtype), *[unpack(a["found"], dtype) for a in told if a["kind"] == kind]])
            if len(found) != len(keys):
                raise ValueError(f"{len(keys)} hashes asked for, {len(found)} answered")
            look.append(Exact(keys, found))
        out = [_score(part, r, look[UNIGRAM], lambda k: look[BIGRAM](k).astype(np.int64), total, distinct, beta) for part, r in zip(parts, read, strict=True)]
        return pa.Table.from_batches(out) if out else pa.Table.from_pydict({}, pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))

    # both groupings of the texts go by the same shuffle
    asked = dealt.groupBy("bucket").applyInArrow(ask, "kind int, group int, bucket int, keys binary")
    answered = asked.groupBy("kind", "group").cogroup(counts.groupBy("kind", "group")).applyInArrow(answer, "bucket int, kind int, group int, found binary")
    return dealt.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(score, RESULT)


def score_texts(docs: DataFrame, *, beta: float = BETA, segment_bytes: int = SEGMENT_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) the columns of RESULT.

    Counts come from the rows whose crc32(doc_id as text) mod FOLDS is not 0; the others are held
    out. Null and empty texts are a single end token. A null doc_id counts as empty text, so it is
    held out. Repeated rows count, and are scored, each. With no training rows all counts are 0 and
    the unigram probability is 1. Other columns are ignored; an empty table gives no rows.
    """
    docs = wanted(docs, {"doc_id": "long", "text": "string"})
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(1, -(-size // segment_bytes))
    segment_bits = (segments - 1).bit_length()
    counts = count_ngrams(docs.filter("not held_out"), segment_bits)
    # memory that a worker needs for them
    held, total, distinct = counts.agg(F.sum(F.when(F.col("kind") == BIGRAM, F.octet_length("data")).otherwise(F.col("distinct") * 16)), F.sum(F.when(F.col("kind") == UNIGRAM, F.col("total"))), F.sum(F.when(F.col("kind") == UNIGRAM, F.col("distinct")))).first()
    if (held or 0) <= broadcast_bytes:
        return _broadcast_scores(docs, counts, segment_bits, total or 0, distinct or 0, beta)
    return _shuffled_scores(docs, counts, segment_bits, max(min(int(segments), 1 << LEAST_GROUPS), int(segments) >> BUCKET), total or 0, distinct or 0, beta)
