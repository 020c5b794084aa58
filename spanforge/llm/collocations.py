"""Phrase collocation mining (operator 12): vertical lists of positions, extended word by word.

A task takes texts in blocks and turns each block around: every word has the list of its positions,
its postings, and positions of different pieces are never next to each other. The list of a longer
phrase comes from that of its first words by a merge join of their positions with the postings of
the word that follows. A list's length is the phrase's exact frequency in the block, and the sum over
blocks, which Spark forms from partial sums, that in the corpus.

Only what may be frequent is extended: a phrase's first words and its last words have to be frequent
themselves. Tasks know that from a sieve of a fixed size; what it lets pass wrongly is counted and
then dropped, so that it never changes a result. One pass counts words, one pairs, one runs of three
and four.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import in_packed, materialize, packed, sieve, text_slices, wanted
from spanforge.llm.words import bytes_of, hash_spans, mix

LEAST, TOP, NO_LANG = 30, 2000, "und"
#: Bytes of text in a block, but for a single longer one.
BLOCK = 3 << 20
_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x09, 0x20]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


@dataclass
class Block:
    """Words of a block of texts. row: which text each is in; ids: 64-bit hashes of language and word; at: positions, with a gap between pieces; starts, ends: places in data."""

    data: np.ndarray
    row: np.ndarray
    ids: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def block_of(texts: pa.Array, langs: pa.Array) -> Block:
    """The words of ``texts``; A-Z count as a-z."""
    data, rows = bytes_of(texts)
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    inside = ~(_BLANK | _BREAK)[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[rows] = True
    starts = np.flatnonzero(inside & (cut[:-1] | np.concatenate([[True], ~inside[:-1]])[: len(data)]))
    ends = np.flatnonzero(inside & (cut[1:] | np.concatenate([~inside[1:], [True]])[: len(data)])) + 1
    row = (np.searchsorted(rows, starts, side="right") - 1).astype(np.int32)
    piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts] + row
    lang_data, lang_rows = bytes_of(langs)
    of_lang = mix(hash_spans(lang_data, lang_rows[:-1], lang_rows[1:]) + np.uint64(1))
    ids = mix(hash_spans(data, starts, ends) ^ of_lang[row])
    ids[ids == 0] = 1
    return Block(data, row, ids, np.arange(len(starts)) + np.concatenate([[0], np.cumsum(np.diff(piece) != 0)])[: len(starts)], starts, ends)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for part in text_slices(batches):
        held.append(part)
        total += part.column("text").nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if held and sum(p.num_rows for p in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def word_counts(docs: DataFrame, block: int) -> DataFrame:
    """(lang, word, id, n) for each block, and for each language in it a row without a word that has the number of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches, block):
            b = block_of(part.column("text"), part.column("lang"))
            _, first, n = np.unique(b.ids, return_index=True, return_counts=True)
            size = b.ends[first] - b.starts[first]
            offsets = np.concatenate([[0], np.cumsum(size)])
            chars = b.data[np.arange(offsets[-1]) + np.repeat(b.starts[first] - offsets[:-1], size)]
            words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(chars.tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(b.row[first])), words, _long(b.ids[first]), pa.array(n)], ["lang", "word", "id", "n"])
            total = np.bincount(b.row, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.nulls(part.num_rows, pa.string()), pa.array(np.zeros(part.num_rows, np.int64)), pa.array(total)], ["lang", "word", "id", "n"])

    return docs.mapInArrow(run, "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def pair_key(first: Column, second: Column) -> Column:
    """A hash of two ids."""
    turned = F.call_function("shiftleft", second, F.lit(17)).bitwiseOR(F.shiftrightunsigned(second, 47))
    return first.bitwiseXOR(turned)


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first ^ (second << np.uint64(17) | second >> np.uint64(47))


@dataclass
class Lists:
    """Lists of the positions of phrases of one length. at: all positions, in order; code: whose list each is in; ids: the words' ids of each phrase, a row each."""

    at: np.ndarray
    code: np.ndarray
    ids: np.ndarray

    def lengths(self) -> np.ndarray:
        return np.bincount(self.code, minlength=len(self.ids))

    def only(self, kept: np.ndarray) -> Lists:
        """Those of the phrases that ``kept`` says."""
        stays = kept[self.code]
        return Lists(self.at[stays], (np.cumsum(kept) - 1)[self.code[stays]], self.ids[kept])


def postings(block: Block) -> Lists:
    ids, code = np.unique(block.ids, return_inverse=True)
    return Lists(block.at, code, ids[:, None])


def extended(lists: Lists, words: Lists) -> Lists:
    """Lists of all phrases of ``lists`` with a word of ``words`` behind them: a merge join of positions."""
    want = lists.at + lists.ids.shape[1]
    place = np.minimum(np.searchsorted(words.at, want), max(0, len(words.at) - 1))
    hit = words.at[place] == want if len(words.at) else np.zeros(len(want), bool)
    n_words = max(1, len(words.ids))
    both, code = np.unique(lists.code[hit] * n_words + words.code[place[hit]], return_inverse=True)
    return Lists(lists.at[hit], code, np.concatenate([lists.ids[both // n_words], words.ids[both % n_words]], axis=1))


def _followed(lists: Lists) -> Lists:
    """The positions of ``lists`` right behind which another of its phrases begins."""
    stays = np.isin(lists.at + 1, lists.at)
    return Lists(lists.at[stays], lists.code[stays], lists.ids)


def phrase_counts(docs: DataFrame, words: np.ndarray, pairs: np.ndarray | None, block: int) -> DataFrame:
    """(w1, w2, w3, w4, n): the pairs of words that pass the sieve ``words``, or the runs of three and four words all pairs of which pass ``pairs``; what a phrase doesn't have is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches, block):
            post = postings(block_of(part.column("text"), part.column("lang")))
            post = post.only(in_packed(words, post.ids[:, 0]))
            found = extended(post, post)
            if pairs is None:
                out = [found]
            else:
                found = found.only(in_packed(pairs, _pair_key(found.ids[:, 0], found.ids[:, 1])))
                three = extended(_followed(found), post)
                out = [three, extended(_followed(three), post)]
            for lists in out:
                n = lists.lengths()
                ids = np.concatenate([lists.ids, np.zeros((len(lists.ids), 4 - lists.ids.shape[1]), np.uint64)], axis=1)[n > 0]
                yield pa.RecordBatch.from_arrays([*[_long(ids[:, i]) for i in range(4)], pa.array(n[n > 0])], ["w1", "w2", "w3", "w4", "n"])

    return docs.mapInArrow(run, "w1 long, w2 long, w3 long, w4 long, n long").groupBy("w1", "w2", "w3", "w4").agg(F.sum("n").alias("n"))


def _joined(phrases: DataFrame, shorter: DataFrame, size: int) -> DataFrame:
    """``phrases`` of ``size`` words with what those of one word less know: lang, words, and the frequencies of the parts before and after each cut."""
    of = [f"w{i}" for i in range(1, size + 1)]
    side = lambda name, ids: shorter.select(*[F.col(f"w{i}").alias(c) for i, c in enumerate(ids, 1)], *[F.col(c).alias(f"{name}_{c}") for c in ("lang", "words", "a", "before", "after")])
    both = phrases.select(*of, F.col("n").alias("a")).join(side("p", of[:-1]), of[:-1]).join(side("s", of[1:]), of[1:])
    words = F.concat("p_words", F.slice("s_words", size - 1, 1))
    return both.select(*of, F.col("p_lang").alias("lang"), words.alias("words"), "a", F.concat("p_before", F.array("p_a")).alias("before"), F.concat(F.array("s_a"), "s_after").alias("after"))


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Candidates (w1..w4, m, lang, words, a, before, after) of two to four words, and (lang, n)."""
    counted = materialize(word_counts(docs, block).filter(f"n >= {least} or word is null"), "words")
    one = counted.filter(f"word is not null and n >= {least}")
    words = packed(sieve(one, F.col("id"), "word_sieve"))
    pairs = materialize(phrase_counts(docs, words, None, block).filter(f"n >= {least}"), "pairs")
    runs = phrase_counts(docs, words, packed(sieve(pairs, pair_key(F.col("w1"), F.col("w2")), "pair_sieve")), block)
    runs = materialize(runs.filter(f"n >= {least}"), "runs")
    none = F.array().cast("array<long>")
    shorter = one.select(F.col("id").alias("w1"), "lang", F.array("word").alias("words"), F.col("n").alias("a"), none.alias("before"), none.alias("after"))
    out = []
    for size, found in ((2, pairs), (3, runs.filter("w4 = 0")), (4, runs.filter("w4 <> 0"))):
        shorter = materialize(_joined(found, shorter, size), f"phrases{size}")
        out.append(shorter.select(*[F.col(f"w{i}") if i <= size else F.lit(0).cast("long").alias(f"w{i}") for i in range(1, 5)], F.lit(size).alias("m"), "lang", "words", "a", "before", "after"))
    totals = counted.filter("word is null").select("lang", "n")
    return out[0].union(out[1]).union(out[2]), totals


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The ``top`` collocations of each language of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z. Pieces end at . , ; : ! ? and at line breaks, words at spaces and tabs. A
    candidate is a phrase of 2 to 4 words with ``least`` occurrences or more (a) inside pieces,
    overlaps included. Of its cuts in two the one with the lowest score floor(2000000 a / (l + r))
    counts, of equal ones the first, with l and r the occurrences of the two parts. Candidates in a
    longer candidate with at least 80 % as many occurrences are out. n: all words of the language.
    A null lang is `und`, a null or empty text has no words, each row counts as often as it is there;
    other columns are ignored; an empty table gives no rows. Words count as equal if 64-bit hashes of
    language and word are.
    """
    texts = wanted(docs, {"text": "string", "lang": "string"}).withColumn("lang", F.coalesce("lang", F.lit(NO_LANG)))
    found, totals = frequent_phrases(texts, least=least, block=block)
    inside = F.expr("flatten(transform(sequence(2, m - 1), j -> transform(sequence(1, m - j + 1), i -> slice(array(w1, w2, w3, w4), i, j))))")
    longer = found.filter("m > 2").select(F.explode(inside).alias("part"), "a").groupBy("part").agg(F.max("a").alias("most"))
    parts = longer.select(*[F.coalesce(F.get("part", F.lit(i)), F.lit(0).cast("long")).alias(f"w{i + 1}") for i in range(4)], "most")
    left = found.join(parts, ["w1", "w2", "w3", "w4"], "left").filter("most is null or 100 * most < 80 * a")
    cut = F.expr("array_min(transform(sequence(1, m - 1), k -> struct((cast(a as decimal(20, 0)) * 2000000) div cast(before[k - 1] + after[k - 1] as decimal(20, 0)) as score, k as k, before[k - 1] as l, after[k - 1] as r)))")
    scored = left.select("lang", F.array_join("words", " ").alias("phrase"), "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
