"""Quality rules (operator 4): base counts, and repetition measured by a suffix array over words.

The suffix array is built for a slice of documents at once by prefix doubling; two suffixes of
different documents never meet, because the document is part of the first sort key. Adjacent
suffixes' longest common prefixes give intervals, each of which is a repeated substring (a run of
words) that can't be made longer to the right; those whose occurrences also differ to the left are
the maximal repeats. The verdict limits the fraction of words that the union of the repeats' spans
covers, and the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import small_batches, text_slices, wanted
from spanforge.llm.words import Words, hash_spans, mix, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Shortest run of words that counts as a repeat; most of a document's words that repeats may cover; most of them that one repeat may have.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.45, 0.25

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_repeats long, covered_words long, longest_repeat long, kept boolean"
)


def suffix_array(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of each document's ``symbols`` in order, and the longest common prefix of each with the one before.

    ``first`` holds the documents' offsets. Suffixes of different documents share nothing.
    """
    n = len(symbols)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][doc]
    order = np.lexsort((symbols, doc))
    new = np.ones(n, bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # ranks of each doubling are kept: 4 bytes a word for each of log2(longest repeat) levels
    levels, step = [rank], 1
    active = order[~(new & np.concatenate([new[1:], [True]]))]
    while len(active):
        after = active + step
        follow = np.where(after < end[active], rank[np.minimum(after, n - 1)], -1).astype(np.int64)
        key = rank[active].astype(np.int64) * (n + 1) + follow + 1
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        at = np.arange(len(active))
        head = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        sub = np.maximum.accumulate(np.where(fresh, at, 0))
        rank = rank.copy()
        rank[active] = old + (sub - head)
        levels.append(rank)
        step *= 2
        active = active[~(fresh & np.concatenate([fresh[1:], [True]]))]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    common = np.zeros(n, np.int64)
    pair = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1
    a, b, length = suffixes[pair], suffixes[pair - 1], np.zeros(len(pair), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ok = (a < end[suffixes[pair]]) & (b < end[suffixes[pair]])
        same = ok & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        width = same.astype(np.int64) << level
        a, b, length = a + width, b + width, length + width
    common[pair] = length
    return suffixes, common


def maximal_repeats(symbols: np.ndarray, first: np.ndarray, least: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Maximal repeats of ``least`` symbols or more as (length, start of one occurrence, occurrences); and for each place the longest repeat that starts there."""
    n = len(symbols)
    longest = np.zeros(n, np.int64)
    if not n:
        return [], longest
    suffixes, common = suffix_array(symbols, first)
    nearest = np.maximum(common, np.concatenate([common[1:], [0]]))
    longest[suffixes] = np.where(nearest >= least, nearest, 0)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    # the symbol to the left of each suffix; documents' first suffixes have one of their own
    left = np.where(begins[suffixes], -1 - suffixes, np.concatenate([[0], symbols.view(np.int64)[:-1] >> 1])[suffixes])
    found = []
    hot = np.flatnonzero(common >= least)
    for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1) if len(hot) else []:
        lo, hi = int(run[0]) - 1, int(run[-1])
        lcp = common[lo + 1 : hi + 1].tolist() + [0]
        lefts = left[lo : hi + 1].tolist()
        stack: list[list] = []  # [length, first suffix, left symbol or None if several]
        for i, length in enumerate(lcp):
            begin, symbol = i, lefts[i]
            while stack and stack[-1][0] > length:
                top = stack.pop()
                if top[2] != symbol:
                    top[2] = None
                if top[2] is None:
                    found.append((top[0], int(suffixes[lo + top[1]]), i - top[1] + 1))
                begin, symbol = top[1], top[2]
            if stack and stack[-1][0] == length:
                if stack[-1][2] != symbol:
                    stack[-1][2] = None
            elif length >= least:
                stack.append([length, begin, symbol])
    return found, longest


def _spread(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


def _by_doc(first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
    return np.diff(sums[first])


def repeat_words(words: Words, hashes: np.ndarray, n: int = 3) -> np.ndarray:
    """For each document, the words in windows of ``n`` words that it has twice or more."""
    total, row = len(hashes), words.row_of()
    if total < n:
        return np.zeros(len(words.first) - 1, np.int64)
    at = np.flatnonzero(words.first[1:][row] - np.arange(total) >= n)
    key = row[at].astype(np.uint64)
    for i in range(n):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[at + i])
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    twice = at[by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(at) else at
    return _by_doc(words.first, _spread(total, twice, np.full(len(twice), n)))


def duplicate_lines(words: Words) -> np.ndarray:
    """For each document, the lines that have a word and equal an earlier line."""
    data, rows = words.data, words.rows
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([rows[:-1], breaks + 1]))
    doc = np.searchsorted(rows, starts, side="right") - 1
    # a line break that ends a row starts a line in that row, at the row's end
    after = np.sort(np.concatenate([rows[1:], breaks]))
    line_doc = np.sort(np.concatenate([np.arange(len(rows) - 1), np.searchsorted(rows, breaks, side="right") - 1]))
    ends = after
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, doc = starts[full], ends[full], line_doc[full]
    h = hash_spans(data, starts, ends)
    by = np.lexsort((h, doc))
    again = np.concatenate([[False], (h[by][1:] == h[by][:-1]) & (doc[by][1:] == doc[by][:-1])]) if len(by) else np.zeros(0, bool)
    return np.bincount(doc[by][again], minlength=len(rows) - 1)


def measure(texts: pa.Array, min_repeat: int, max_covered: float, max_longest: float) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for a string array without nulls."""
    words = words_of(texts)
    h = words.hashes()
    count = np.diff(words.first)
    repeated = repeat_words(words, h)
    found, longest = maximal_repeats(h, words.first, min_repeat)
    places = np.flatnonzero(longest)
    covered = _by_doc(words.first, _spread(len(h), places, longest[places]))
    row = words.row_of()
    most = np.zeros(len(count), np.int64)
    np.maximum.at(most, row[places], longest[places])
    n_repeats = np.bincount(row[np.array([s for _, s, _ in found], np.int64)], minlength=len(count))
    lead = (words.data & 0xC0) != 0x80
    failed = (count < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * count)
    inside = np.zeros(256, bool)
    inside[:] = True
    inside[[9, 10, 11, 12, 13, 32]] = False
    return {
        "n_words": count,
        "word_chars": words.row_sums(lead & inside[words.data]),
        "n_symbols": words.row_sums(SYMBOLS[words.data]),
        "n_dup_lines": duplicate_lines(words),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "n_repeats": n_repeats,
        "covered_words": covered,
        "longest_repeat": most,
        "kept": ~failed & (covered <= max_covered * count) & (most <= max_longest * count),
    }


def quality(docs: DataFrame, *, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id and the columns of SCHEMA.

    One narrow pass over whole texts; nothing is shuffled. Null and empty texts have no words: all
    counts are 0, base_failed is true, kept false. A null doc_id stays null, repeated rows give
    repeated results, and other columns of ``docs`` are ignored. An empty table gives no rows.
    Memory follows 1 MB of text, or the longest single text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            got = measure(part.column("text"), min_repeat, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(v) for v in got.values()]], ["doc_id", *got])

    return wanted(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, f"doc_id long, {SCHEMA}")


def keep_good(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns of ``docs``, in one narrow pass."""
    small_batches(docs.sparkSession)
    limits = {"min_repeat": MIN_REPEAT, "max_covered": MAX_COVERED, "max_longest": MAX_LONGEST} | limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield part.filter(pa.array(measure(part.column("text"), **limits)["kept"]))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
