"""Names of any length in texts: every run of words of a length that some name has is looked up by its hash.

Runs are never made: prefix sums of the words' hashes give the hash of any run, and a Bloom filter of
a fixed size tells in the task which of them can be names. Those few rows, of a page, a place and
two hashes, then meet the names by a join. A name's head is its first words, as many as the largest
power of two that it has: only where a head stands are the lengths tried that share its size, so that
the work for a text grows with its words and the logarithm of the longest name, not with the names
or their different lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.session import keep

#: Words of 64 bits of the filter: 8 MB, whatever the number of names. One with very many names lets all runs pass, which costs time but no result.
SLOTS = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # odd, so that they have inverses modulo 2**64
#: Words that a task looks at together, but for a single longer text.
_CHUNK = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for base in _BASES:
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        out.append((pair[0], pair[1]))
    return out


def run_hashes(hashes: np.ndarray, starts: np.ndarray, size: int | np.ndarray, powers: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Two hashes of each run of words that begins at ``starts`` and has ``size`` words."""
    out = []
    for up, down in powers:
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(_mixed(hashes + np.uint64(1)) * up[: len(hashes)], out=sums[1:])
        out.append(_mixed((sums[starts + size] - sums[starts]) * down[starts]))
    return out


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _head(n: int) -> int:
    """How many words the head of a name of ``n`` words has."""
    return 1 << (int(n).bit_length() - 1)


def hashed_names(names: DataFrame) -> DataFrame:
    """(name, n, h1, h2, g1, g2) of the distinct names (name: words parted by single spaces): number of words, and two hashes of all of them and of their heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            head = np.array([_head(x) for x in n.tolist()], np.int64)
            found = [h for size in (n, head) for h in run_hashes(hashes, np.cumsum(n) - n, size, _powers(len(hashes) + 1))]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(n, pa.int32()), *[pa.array(h.view(np.int64)) for h in found]], ["name", "n", "h1", "h2", "g1", "g2"])

    split = names.select("name").filter("name is not null").distinct().select("name", _word_hashes(F.split("name", " ")).alias("hashes"))
    return split.mapInArrow(run, "name string, n int, h1 long, h2 long, g1 long, g2 long")


def _filter_bits(hashed: DataFrame) -> np.ndarray:
    """The Bloom filter over both hashes (h1, h2) of the names or heads; at most SLOTS rows come to the driver."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h2", 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    rows = hashed.select(F.col("h1").bitwiseAND(F.lit(SLOTS - 1)).alias("slot"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3]).alias("bits")).groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(SLOTS, np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _may_be_names(bits: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    own = np.zeros(len(one), np.uint64)
    for i in range(4):
        own |= np.uint64(1) << (two >> np.uint64(6 * i) & np.uint64(63))
    return bits[(one & np.uint64(SLOTS - 1)).astype(np.int64)] & own == own


def name_runs(docs: DataFrame, names: DataFrame, longest: int | None = None) -> DataFrame:
    """(page, start, n, name) of all runs of words of docs (page, words) that are names (name), of up to ``longest`` words or of any number.

    Null words match nothing, and no run goes over one; null and empty arrays have no names. A page
    that is there twice has its runs twice.
    """
    hashed = hashed_names(names)
    hashed = keep(hashed.filter(F.col("n") <= longest) if longest else hashed, "names")
    lengths = sorted(r.n for r in hashed.select("n").distinct().collect())  # a number for each length of names
    bits = _filter_bits(hashed)
    by_head = {h: [n for n in lengths if _head(n) == h] for h in sorted({_head(n) for n in lengths})}
    heads = _filter_bits(hashed.select(F.col("g1").alias("h1"), F.col("g2").alias("h2"))) if len(by_head) < len(lengths) else bits
    kind = dict(docs.dtypes)["page"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(1 << 18)
        for batch in batches:
            size = batch.column("hashes").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK, side="right")))
                part, own = batch.slice(at, stop - at), size[at:stop]
                at = stop
                flat = part.column("hashes").flatten()
                nulls = flat.is_null().to_numpy(zero_copy_only=False)
                hashes = flat.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
                if len(hashes) >= len(powers[0][0]):
                    powers = _powers(2 * len(hashes))
                row = np.repeat(np.arange(len(own)), own)
                first = np.cumsum(own) - own
                left = np.repeat(first + own, own) - np.arange(len(hashes))  # words from here to the text's end
                unknown = np.concatenate([[0], np.cumsum(nulls)])
                sums = []
                for up, down in powers:
                    total = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(_mixed(hashes + np.uint64(1)) * up[: len(hashes)], out=total[1:])
                    sums.append((total, down))
                for h, some in by_head.items():
                    # where a head stands and the shortest of its names has room; a single length is looked up itself
                    n = some[0] if len(some) == 1 else h
                    until = max(0, len(hashes) - n + 1)
                    one, two = (_mixed((total[n:] - total[:until]) * down[:until]) for total, down in sums) if until else (np.zeros(0, np.uint64),) * 2
                    hit = np.flatnonzero(_may_be_names(bits if len(some) == 1 else heads, one, two) & (left[:until] >= some[0]))
                    for n in some:
                        starts = hit[(left[hit] >= n) & (unknown[np.minimum(hit + n, len(hashes))] == unknown[hit])]
                        one, two = (_mixed((total[starts + n] - total[starts]) * down[starts]) for total, down in sums)
                        known = _may_be_names(bits, one, two)
                        starts, one, two = starts[known], one[known], two[known]
                        if len(starts):
                            page = part.column("page").take(pa.array(row[starts]))
                            yield pa.RecordBatch.from_arrays([page, pa.array(starts - first[row[starts]], pa.int32()), pa.array(np.full(len(starts), n), pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["page", "start", "n", "h1", "h2"])

    known = F.transform("words", lambda w: F.when(w.isNotNull(), F.xxhash64(w)))
    rows = docs.filter(F.size("words") > 0).select("page", known.alias("hashes"))
    met = rows.mapInArrow(run, f"page {kind}, start int, n int, h1 long, h2 long")
    return met.join(hashed, ["n", "h1", "h2"]).select("page", "start", "n", "name")
