"""Orders by chance: datasets drawn by rate until all are used up, and a shuffle buffer that streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.ordering import in_order

#: Steps of a unit of time: times are whole numbers, so that their sums are the same however rows are dealt.
STEPS = 1 << 20


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number between 0 and 1, both excluded, that hangs on seed and keys alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12) + 0.5) / float(1 << 52)


def drawn_order(rows: DataFrame, rates: DataFrame, key: str, *, chance: Column | None = None, seed: int = 0) -> DataFrame:
    """``rows`` (dataset, key) with place, from 0: the order in which they come if a dataset is drawn by rate, again and again, and gives its next row by ``key``, until all are used up.

    ``rates`` (dataset, rate): any positive numbers. Draws of a dataset that has no rows left are passed
    over. Drawing is done by all rows at once: if the rows of each dataset arrive one after another
    with exponential gaps of mean 1 / rate, the next to arrive is of any dataset with a chance in
    proportion to its rate, whatever came before. So the sum of a dataset's gaps up to a row is the
    row's time, and times give the order. ``chance``: numbers between 0 and 1, one for each row, in
    place of those that hang on seed, dataset and key. Rows of a dataset without a rate don't come.
    """
    u = uniform("dataset", key, seed=seed) if chance is None else chance
    gap = F.floor(-F.log(u) * STEPS / F.col("__rate")).cast("long")
    joined = rows.join(rates.select("dataset", F.col("rate").cast("double").alias("__rate")), "dataset").withColumn("__gap", gap)
    summed = in_order(joined, "dataset", key, place="__at", sums={"__run": F.col("__gap")})
    before = summed.groupBy("dataset").agg(F.min(F.col("__run") - F.col("__gap")).alias("__before"))
    timed = summed.join(before, "dataset").withColumn("__time", F.col("__run") - F.col("__before"))
    return in_order(timed, "__time", "dataset", key).select(*[f"`{c}`" for c in rows.columns], "place")


def shuffle_buffer(rows: DataFrame, size: int, seed: int = 0, *, skip: int = 0, workers: int = 1, worker: int = 0) -> DataFrame:
    """``rows`` as they leave a buffer of ``size`` rows: each that comes in takes the place of one drawn from those held, which goes out.

    Each partition is a stream of its own and no row leaves it: what is held is the buffer and one
    batch, whatever the partition's size. Of what goes out the first ``skip`` rows of a stream are
    passed over, then every ``workers``-th row from ``worker`` on stays. Draws hang on seed and partition.
    """
    if size < 1 or not 0 <= worker < workers or skip < 0:
        raise ValueError("size and workers are 1 or more, worker is one of them, skip isn't negative")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held, gone = None, 0

        def leave(table: pa.Table, out: np.ndarray) -> pa.RecordBatch | None:
            nonlocal gone
            place = np.arange(gone, gone + len(out))
            gone += len(out)
            stays = out[(place >= skip) & ((place - skip) % workers == worker)]
            return table.take(pa.array(stays)).combine_chunks().to_batches()[0] if len(stays) else None

        for batch in batches:
            both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if both.num_rows <= size:
                held = both.combine_chunks()
                continue
            slots, out = list(range(size)), []
            for i, slot in enumerate(rng.integers(0, size, both.num_rows - size).tolist(), size):
                out.append(slots[slot])
                slots[slot] = i
            if part := leave(both, np.array(out)):
                yield part
            held = both.take(pa.array(slots)).combine_chunks()
        if held is not None and held.num_rows and (part := leave(held, rng.permutation(held.num_rows))):
            yield part

    return rows.mapInArrow(run, rows.schema)
