"""Model inputs: sentences packed into examples, masks, mixing, shards."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.text import padded, share_of
from spanforge.operators.ordering import in_order
from spanforge.session import small_batches

#: Tokens whose rows a task makes together, but for those of a single longer document.
_HELD = 50_000


def pack_sentences(sentences: DataFrame, most: int, least: int = 1) -> DataFrame:
    """(page, sent, bin) for sentences (page, sent, n) of ``least`` to ``most`` words: in order, a bin is full when the next sentence would exceed ``most``.

    Where a bin ends hangs on where the one before did, so that a page's sentences go by in order;
    none but the last is remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, at, used = object(), 0, 0
        for batch in batches:
            bins = []
            for p, n in zip(batch.column("page").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if p != page:
                    page, at, used = p, 0, n
                elif used + n > most:
                    at, used = at + 1, n
                else:
                    used += n
                bins.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("sent"), pa.array(bins, pa.int32())], ["page", "sent", "bin"])

    kept = sentences.filter(F.col("n").between(least, most)).select("page", "sent", "n")
    kinds = dict(kept.dtypes)
    return kept.repartition("page").sortWithinPartitions("page", "sent").mapInArrow(run, f"page {kinds['page']}, sent {kinds['sent']}, bin int")


def examples(packed: DataFrame, most_entities: int | None = None, keep_empty: bool = True) -> DataFrame:
    """(page, bin, words, entities): the bins of packed (page, bin, sent, words, entities: array of struct<title, start, end>); entities move with their sentence."""
    ordered = packed.groupBy("page", "bin").agg(F.array_sort(F.collect_list(F.struct("sent", "words", "entities"))).alias("all"))
    first = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<title:string,start:int,end:int>>))")
    moved = F.aggregate("all", first, lambda s, x: F.struct((s["at"] + F.size(x["words"])).alias("at"), F.concat(s["out"], F.transform(x["entities"], lambda e: F.struct(e["title"].alias("title"), (e["start"] + s["at"]).cast("int").alias("start"), (e["end"] + s["at"]).cast("int").alias("end")))).alias("out")))["out"]
    out = ordered.select("page", "bin", F.flatten("all.words").alias("words"), (moved if most_entities is None else F.slice(moved, 1, most_entities)).alias("entities"))
    return out if keep_empty else out.filter(F.size("entities") > 0)


def draw(*keys: Column | str) -> Column:
    """A number from 0 to 1 (exclusive) that hangs on the keys alone: the same in each run."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *keys)), 1, 8), 16, 10).cast("double") / 4294967296.0


def action_of(u: Column) -> Column:
    """What becomes of a masked token by its draw: 80 % mask, then 10 % random, then 10 % keep."""
    return F.when(u < 0.8, "mask").when(u < 0.9, "random").otherwise("keep")


def _digests(key: str, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MD5 of key, - and place, as two whole numbers that order as its hexadecimal form does."""
    start = key + "-" if key is not None else ""
    raw = np.frombuffer(b"".join([hashlib.md5(f"{start}{p}".encode()).digest() for p in places.tolist()]), ">u8").reshape(-1, 2)
    return raw[:, 0].astype(np.uint64), raw[:, 1].astype(np.uint64)


def _draws(name: str, key: str, places: np.ndarray) -> np.ndarray:
    """``draw`` of name, key and each place."""
    return (_digests(name if key is None else f"{name}-{key}", places)[0] >> np.uint64(32)).astype(np.float64) / 4294967296.0


def _actions(u: np.ndarray) -> np.ndarray:
    """``action_of`` as 0 to 2."""
    return np.where(u < 0.8, 0, np.where(u < 0.9, 1, 2)).astype(np.int8)


_ACTIONS = ("mask", "random", "keep")


def _masked_rows(batches: Iterator[pa.RecordBatch], masks: Callable[[str, int, int, dict[str, np.ndarray]], np.ndarray], flags: list[str]) -> Iterator[pa.RecordBatch]:
    """(doc_id, pos, flags, masked, action) of documents (doc_id, key, n, budget, flags: arrays), by the actions (-1: none) that ``masks`` tells of each; some are held at a time."""

    def told(batch: pa.RecordBatch, docs: list[int], actions: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(x) for x in actions])
        of, action = np.repeat(docs, n), np.concatenate(actions)
        pos = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        some = batch.slice(docs[0], docs[-1] - docs[0] + 1)
        named = pa.DictionaryArray.from_arrays(pa.array(action, mask=action < 0), list(_ACTIONS)).cast(pa.string())
        columns = [batch.column("doc_id").take(pa.array(of)), pa.array(pos.astype(np.int32)), *[some.column(c).flatten() for c in flags], pa.array(action >= 0), named]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "pos", *flags, "masked", "action"])

    for batch in batches:
        docs, actions, held = [], [], 0
        keys, lists = batch.column("key").to_pylist(), [batch.column(c) for c in flags]
        n, budget = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("n", "budget"))
        for i, key in enumerate(keys):
            if n[i] > 0:
                own = {c: x[i].values.to_numpy(zero_copy_only=False).astype(bool) for c, x in zip(flags, lists, strict=True)}
                docs.append(i)
                actions.append(masks(key, int(n[i]), int(budget[i]), own))
                held += int(n[i])
            if held > _HELD or docs and i == len(keys) - 1:
                yield told(batch, docs, actions)
                docs, actions, held = [], [], 0


def masked_group_lists(docs: DataFrame, rate: float = 0.15) -> DataFrame:
    """``masked_groups`` of documents (doc_id, subword, entity: an array of flags each), which are a row each: nothing is shuffled."""

    def masks(key: str, n: int, budget: int, own: dict[str, np.ndarray]) -> np.ndarray:
        starts = np.flatnonzero(np.concatenate([[True], ~own["subword"][1:]]))
        size = np.diff(np.append(starts, n))
        entity = own["entity"]
        action = np.full(n, -1, np.int8)
        left = budget - int(entity.sum())
        if left > 0:
            free = np.flatnonzero(~np.logical_or.reduceat(entity, starts))
            high, low = _digests(key, starts[free])
            chosen = []
            for g in free[np.lexsort((low, high))].tolist():
                if size[g] <= left:
                    chosen.append(g)
                    left -= int(size[g])
                    if not left:
                        break
            chosen = np.array(chosen, np.int64)
            if len(chosen):
                of = np.repeat(_actions(_draws("action", key, starts[chosen])), size[chosen])
                nth = np.arange(len(of)) - np.repeat(np.cumsum(size[chosen]) - size[chosen], size[chosen])
                action[np.repeat(starts[chosen], size[chosen]) + nth] = of
        masked = np.flatnonzero(entity)
        if len(masked):
            action[masked] = _actions(_draws("action", key, masked))
        if (action < 0).all():
            one = int(hashlib.md5(("forced" if key is None else f"forced-{key}").encode()).hexdigest()[:8], 16) / 4294967296.0
            action[int(one * max(1, n - 2))] = 0
        return action

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    n = F.size("subword")
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("key"), n.alias("n"), share_of(n, rate).alias("budget"), "subword", "entity")
    return rows.mapInArrow(lambda b: _masked_rows(b, masks, ["subword", "entity"]), f"doc_id {kind}, pos int, subword boolean, entity boolean, masked boolean, action string")


def masked_groups(tokens: DataFrame, rate: float = 0.15) -> DataFrame:
    """tokens (doc_id, pos from 0, subword, entity: whether in the span of a masked entity) with masked and action, whole words together.

    A document has a budget of ``rate`` of its tokens, 1 at least. Entity tokens are masked first
    and count. Other words come in a drawn order, each masked with all its tokens if it fits what
    is left. Where nothing fits, one token (but the last two, if there are others) is masked. A word
    has one draw for what becomes of its tokens, an entity's tokens one each.
    """
    lists = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "subword", "entity"))).alias("all"))
    out = masked_group_lists(lists.select("doc_id", F.col("all.subword").alias("subword"), F.col("all.entity").alias("entity")), rate)
    return out.withColumn("pos", F.col("pos").cast(dict(tokens.dtypes)["pos"]))


def masked_entities(entities: DataFrame, rate: float = 0.3) -> DataFrame:
    """entities (doc_id, index, positions: array<int>, -1 as padding) with masked and action: ``rate`` of a document's, 1 at least; positions move behind [CLS]."""
    order = Window.partitionBy("doc_id").orderBy(F.md5(F.concat_ws("-", F.lit("entity"), "doc_id", "index")), "index")
    n = F.count("*").over(Window.partitionBy("doc_id"))
    rows = entities.withColumn("masked", F.row_number().over(order) <= share_of(n, rate))
    moved = F.transform("positions", lambda p: F.when(p == -1, -1).otherwise(p + 1).cast("int"))
    return rows.withColumn("action", F.when(F.col("masked"), action_of(draw(F.lit("entity action"), "doc_id", "index")))).withColumn("positions", moved)


def masked_words(docs: DataFrame, rate: float = 0.15) -> DataFrame:
    """(doc_id, pos, masked, action) of the words of docs (doc_id, n: how many): ``rate`` of a document's words, 1 at least; of them 80 % mask, 10 % random, 10 % keep. Nothing is shuffled."""

    def masks(key: str, n: int, budget: int, own: dict[str, np.ndarray]) -> np.ndarray:
        high, low = _digests(key, np.arange(n))
        masked = np.lexsort((low, high))[:budget]
        action = np.full(n, -1, np.int8)
        action[masked] = _actions(_draws("action", key, masked))
        return action

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("n").cast("int").alias("n"), share_of(F.col("n"), rate).alias("budget"))
    return rows.mapInArrow(lambda b: _masked_rows(b, masks, []), f"doc_id {kind}, pos int, masked boolean, action string")


def mixing_rates(sizes: DataFrame, smoothing: float = 0.7) -> DataFrame:
    """(dataset, size, rate): shares of sizes (dataset, size) to the power ``smoothing``."""
    power = F.pow(F.col("size").cast("double"), F.lit(smoothing))
    return sizes.select("dataset", "size", (power / F.sum(power).over(Window.partitionBy(F.lit(0)))).alias("rate"))


def mixed_order(rows: DataFrame, rates: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` (dataset, key) with order, by which they come as if datasets were drawn by rate until all are used up."""
    joined = rows.join(rates.select("dataset", "rate"), "dataset").withColumn("__hash", F.md5(F.concat_ws("-", "dataset", key)))
    placed = in_order(joined, "dataset", "__hash", key, place="__at")
    first = placed.groupBy("dataset").agg(F.min("__at").alias("__first"))
    n = F.col("__at") - F.col("__first") + 1
    # the n-th row of a dataset comes about when n / rate draws have been made
    return placed.join(first, "dataset").withColumn("order", (n - draw("dataset", key)) / F.col("rate")).select(*[f"`{c}`" for c in rows.columns], "order")


def train_steps(sizes: DataFrame, batch: int, epochs: int) -> DataFrame:
    return sizes.agg(F.ceil(F.sum("size") * epochs / batch).cast("long").alias("steps"))


def shard(rows: DataFrame, key: str, workers: int, worker: int, skip: int = 0) -> DataFrame:
    """Every ``workers``-th of the rows behind the first ``skip``, in order of ``key``."""
    ranked = in_order(rows, key, place="__n")
    return ranked.filter((F.col("__n") >= skip) & (F.pmod(F.col("__n") - skip, F.lit(workers)) == worker)).drop("__n")


def shuffled(rows: DataFrame, key: str, seed: int, limit: int) -> DataFrame:
    """``limit`` rows in an order that hangs on seed and key alone."""
    return rows.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), key)), key).limit(limit)


def batches(rows: DataFrame, key: str, size: int, length: str) -> DataFrame:
    """``rows`` with batch (``size`` rows each, in order of ``key``) and width, the longest ``length`` in it."""
    ranked = in_order(rows, key, place="batch").withColumn("batch", F.floor(F.col("batch") / size))
    return ranked.withColumn("width", F.max(length).over(Window.partitionBy("batch")))


def replacement(low: int, high: int, *keys: Column | str) -> Column:
    """A whole number from low to high (exclusive) that hangs on the keys alone."""
    return (F.lit(low) + F.floor(draw(F.lit("replace"), *keys) * (high - low))).cast("long")


def warmup_rate(step: Column | str, warmup: int, total: int) -> Column:
    """The share of the learning rate at a step: up linearly over ``warmup`` steps, then down to 0 at ``total``."""
    s = F.col(step) if isinstance(step, str) else step
    down = F.greatest(F.lit(0.0), (total - s) / F.lit(float(max(1, total - warmup))))
    return F.when(s < warmup, s / F.lit(float(max(1, warmup)))).otherwise(down)


def padded_batches(rows: DataFrame, key: str, size: int, columns: dict[str, int]) -> DataFrame:
    """``rows`` with batch (``size`` rows each, in order of ``key``); each array of ``columns`` padded with its value to the longest of its batch."""
    out = in_order(rows, key, place="batch").withColumn("batch", F.floor(F.col("batch") / size))
    for name, pad in columns.items():
        out = out.withColumn(name, padded(name, F.max(F.size(name)).over(Window.partitionBy("batch")), pad))
    return out
