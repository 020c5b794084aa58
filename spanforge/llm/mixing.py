"""Mixing sources to target weights (operator 2).

Sources get blocks of BLOCK_WORDS words by Sainte-Laguë's highest quotients, each source's blocks are
dealt to its shards in the same way, and a shard then takes its quota as whole passes over its
documents plus a seeded, contiguous (cyclic) run of blocks in a seeded order of the documents. What
a source's blocks come to above or below its target is one cut block, taken from or given to its
largest shard: a source smaller than a block so takes its target too. A document is cut only where
such a run begins or ends.

Ids are ranked, texts never are: a run is an interval in the order of its shard, so that a shard's
passes, the ends of its run and the few documents cut there tell each document's share where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import WORD, join_small, materialize, wanted

#: A source's target stops at so many times its size.
MOST_REPEATS = 3
#: Words of a block, and of a shard: its ids are ranked in one window, and a row for each shard is kept.
BLOCK_WORDS, SHARD_WORDS = 256, 1 << 19


def sainte_lague(parts: DataFrame, by: list[str], weight: str, seats: str, key: str, out: str) -> DataFrame:
    """Deal ``seats`` (equal within a group ``by``) to the rows of each group by highest quotients weight / (2 s + 1).

    Rounding at the divisor sum(weight) / seats gives a state that the method passes through; the
    few seats that are then over or missing are taken from the lowest or given to the highest
    quotients. A row needs no more candidates than its share of the group's rounding, so that about
    three rows are ranked for each row of ``parts``. Ties go by ``key``, which is unique in a group.
    """
    group = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(0))
    share = F.coalesce(F.try_divide(F.col(weight).cast("double"), F.sum(weight).over(group)), F.lit(0.0))
    rows = parts.withColumn("__share", share).withColumn("__base", F.floor(F.col("__share") * F.col(seats) + 0.5))
    rows = rows.withColumn("__diff", F.when(F.sum(weight).over(group) > 0, F.col(seats) - F.sum("__base").over(group)).otherwise(0))
    room = F.least(F.abs("__diff"), F.ceil(F.col("__share") * F.count("*").over(group) * 1.5) + 2)
    room = F.when(F.col("__diff") < 0, F.least(room, F.col("__base"))).otherwise(room)
    rows = rows.withColumn("__room", room.cast("int"))
    tried = rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__room"))))  # the last only keeps the row
    at = F.when(F.col("__diff") > 0, F.col("__base") + F.col("__i")).otherwise(F.col("__base") - 1 - F.col("__i"))
    quotient = F.try_divide(F.col(weight).cast("double"), 2 * at + 1)
    real = F.col("__i") < F.col("__room")
    # among equal quotients the least key gets a seat first, and so gives one back last
    by_key = F.dense_rank().over(group.orderBy(F.col(key).asc_nulls_last()))
    tried = tried.withColumn("__key", by_key)
    up = F.col("__diff") > 0
    order = [F.when(real, 0).otherwise(1), F.when(up, -quotient).otherwise(quotient), F.when(up, F.col("__key")).otherwise(-F.col("__key")), F.col("__i")]
    tried = tried.withColumn("__rank", F.row_number().over(group.orderBy(*order)))
    moved = F.sum(F.when(real & (F.col("__rank") <= F.abs("__diff")), F.signum("__diff")).otherwise(0)).cast("long")
    kept = [c for c in parts.columns if c not in (*by, key)]
    return tried.groupBy(*by, key).agg(*[F.first(c).alias(c) for c in kept], (F.first("__base") + moved).alias(out))


def targets(sources: DataFrame) -> DataFrame:
    """To sources (source, source_size) add weight (1, 2, 3 repeating by code point, null last) and target.

    Targets share all words by weight, but stop at MOST_REPEATS times the source's size; the excess
    is shared again by weight until none is above. That has a closed form along the order of
    size / weight: all sources up to some place are at their limit, the others share the rest.
    """
    whole = Window.partitionBy(F.lit(0))
    rows = sources.withColumn("weight", (F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    rows = rows.withColumn("__cap", F.col("source_size") * F.lit(MOST_REPEATS).cast("double")).withColumn("__ratio", F.col("__cap") / F.col("weight"))
    up = whole.orderBy("__ratio", F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("__level", level).withColumn("__free", F.col("__ratio") > F.col("__level"))
    shared = F.min(F.when(F.col("__free"), F.struct("__ratio", "__level"))).over(whole)["__level"]
    target = F.when(F.col("__free"), shared * F.col("weight")).otherwise(F.col("__cap"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def shard_quotas(sized: DataFrame, seed: int, block_words: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """Sources (source, source_size, target, n_shards, quota), and shards (source, shard, shard_size, quota, passes, start, length) with what each takes."""
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("seats", F.floor(F.sum("source_size").over(whole) / block_words)).withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int"))
    sources = materialize(sainte_lague(sources, [], "target", "seats", "source", "quota").drop("seats"), "mix-sources")
    dealt = join_small(sized, sources.select("source", "n_shards"), ["source"], "inner", spread=F.col("doc_id"))
    sizes = dealt.withColumn("shard", shard_of(seed)).groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    own = sources.select("source", F.col("quota").alias("source_quota"), (F.round("target").cast("long") - F.col("quota") * block_words).alias("cut"))
    shards = join_small(sizes, own, ["source"], "inner", spread=F.col("shard"))
    shards = sainte_lague(shards, ["source"], "shard_size", "source_quota", "shard", "quota")
    largest = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("shard_size"), "shard")) == 1
    want = F.col("quota") * block_words + F.when(largest, F.col("cut")).otherwise(0)
    shards = shards.withColumn("want", F.greatest(F.lit(0), F.least(want, F.col("shard_size") * MOST_REPEATS)).cast("long"))
    passes = F.coalesce(F.floor(F.try_divide(F.col("want"), F.col("shard_size"))), F.lit(0))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words))
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("shard")), blocks) * block_words
    shards = shards.select("source", "shard", "shard_size", "quota", passes.alias("passes"), (F.col("want") - passes * F.col("shard_size")).alias("length"), start.alias("start"))
    return sources.select("source", "source_size", "target", "n_shards", "quota"), materialize(shards, "mix-shards")


def shard_of(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), F.col("doc_id"), F.col("mark")), F.col("n_shards")).cast("int")


def place_of(seed: int) -> Column:
    """What a shard's documents are ordered by."""
    return F.struct(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("mark")).alias("hash"), F.col("doc_id"), F.col("mark"))


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def take(sized: DataFrame, sources: DataFrame, shards: DataFrame, seed: int) -> DataFrame:
    """To ``sized`` (doc_id, source, size, mark) add source_size, target, shard, place, passes, taken and the spans of words taken once more."""
    rows = join_small(sized, sources.drop("quota"), ["source"], "left", spread=F.col("doc_id")).withColumn("shard", shard_of(seed))
    rows = join_small(rows, shards.drop("quota"), ["source", "shard"], "left", spread=F.col("doc_id")).withColumn("place", place_of(seed))
    upto = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__hi", upto).withColumn("__lo", F.col("__hi") - F.col("size")).withColumn("__end", F.col("start") + F.col("length"))
    clip = lambda at: F.greatest(F.lit(0), F.least(at - F.col("__lo"), F.col("size")))
    rows = rows.withColumn("from_1", clip(F.col("start"))).withColumn("to_1", clip(F.col("__end")))
    rows = rows.withColumn("from_2", F.lit(0).cast("long")).withColumn("to_2", clip(F.col("__end") - F.col("shard_size")))
    # the run goes on at the shard's first word; only there both spans may lie in one document
    rows = rows.withColumn("to_2", F.when(F.col("__end") > F.col("shard_size"), F.col("to_2")).otherwise(0).cast("long"))
    taken = F.col("passes") * F.col("size") + (F.col("to_1") - F.col("from_1")) + (F.col("to_2") - F.col("from_2"))
    return rows.withColumn("taken", taken.cast("long")).drop("__hi", "__lo", "__end", "start", "length", "shard_size", "n_shards")


def mix(docs: DataFrame, *, seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, source, passes and the spans from_1..to_1, from_2..to_2 (words taken besides the passes).

    A source takes its target, rounded, but for what shards can't hold that are at MOST_REPEATS
    times their size. Sources are ranked together, a row each. Null texts have size 0 and take 0; a
    null source is a source of its own; a null doc_id is an id like another. Repeated rows are equal
    in all columns but the spans and what follows from them, and give the same multiset in each run.
    Other columns are ignored; an empty table gives no rows. Rows of sources and shards go to all
    tasks up to SMALL_ROWS of them, beyond that both sides are shuffled; results are equal.
    """
    docs = wanted(docs, {"doc_id": "long", "text": "string", "source": "string"})
    sized = materialize(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("mark")), "mix-sizes")
    sources, shards = shard_quotas(sized, seed, block_words, shard_words)
    rows = take(sized, sources, shards, seed)
    return rows.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "taken", "source", "passes", "from_1", "to_1", "from_2", "to_2")


_SPAN = "array<struct<a:bigint,b:bigint>>"


def _shares(rows: DataFrame) -> DataFrame:
    """To rows of ``take`` add full (times that the document is taken whole) and cuts (its spans that are taken besides)."""
    spans = F.array(*[F.struct(F.col(f"from_{i}").cast("long").alias("a"), F.col(f"to_{i}").cast("long").alias("b")) for i in (1, 2)])
    whole = lambda x: x["b"] - x["a"] == F.col("size")
    some = F.filter(spans, lambda x: x["b"] > x["a"])
    return rows.withColumn("full", F.when(F.col("size") > 0, F.col("passes") + F.size(F.filter(some, whole))).otherwise(0)).withColumn("cuts", F.filter(some, lambda x: ~whole(x)).cast(_SPAN))


def _taken_texts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (columns, __text, __full, __cuts) as often as they are taken, with the text of each time; n_chars, if there, follows."""
    times = F.concat(F.transform(F.when(F.col("__full") > 0, F.sequence(F.lit(1).cast("long"), F.col("__full").cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)")), lambda i: F.expr("cast(null as struct<a:bigint,b:bigint>)")), "__cuts")
    rows = rows.withColumn("__span", F.explode(times))
    # words with what follows each; only texts that are cut come so far
    words, gaps = F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)), F.split("__text", WORD, -1)
    joined = F.zip_with(words, F.slice(gaps, F.lit(2), F.size(words)), lambda w, g: F.concat(w, g))
    a, b = F.col("__span.a").cast("int"), F.col("__span.b").cast("int")
    part = F.concat(F.array_join(F.slice(joined, a + 1, b - a - 1), ""), F.element_at(words, b))
    text = F.when(F.col("__span").isNull(), F.col("__text")).otherwise(part)
    kinds = dict(rows.dtypes)
    changed = {"text": text.cast(kinds["text"])}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(F.col("__span").isNull(), F.col("n_chars")).otherwise(F.length(part).cast(kinds["n_chars"]))
    return rows.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in columns])


def mixed_documents(docs: DataFrame, *, seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once for each time it is taken whole, and the words between where a run of blocks cuts it.

    Cut texts run from their first word's start to their last word's end; n_chars, if there, is
    theirs. Documents without words are in no mix. Equal rows are as many documents. Nulls are as in
    ``mix``; an empty table gives no rows. Rows stay where they are read, but for equal ones.
    """
    hashed = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map" in t else F.col(f"`{c}`") for c, t in docs.dtypes])
    keyed = docs.select("*", F.col("doc_id").cast("long").alias("__id"), F.col("source").cast("string").alias("__source"), hashed.alias("__mark"), F.col("text").cast("string").alias("__text"))
    ids = keyed.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__text").alias("text"), F.col("__mark").alias("mark"))
    sized = materialize(ids.select("doc_id", "source", word_count().alias("size"), "mark"), "mix-sizes")
    sources, shards = shard_quotas(sized, seed, block_words, shard_words)
    key = ["source", "doc_id", "mark"]
    rows = _shares(take(sized, sources, shards, seed).filter("size > 0"))
    rows = materialize(rows.select(*key, "shard", "place", "passes", "full", "cuts", *[(F.col(f"to_{i}") > F.col(f"from_{i}")).alias(f"in_{i}") for i in (1, 2)]), "mix-taken")
    repeated = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("full").alias("full"), F.flatten(F.collect_list(F.when(F.size("cuts") > 0, F.col("cuts")))).alias("cuts")).filter("n > 1").drop("n")
    repeated = materialize(repeated, "mix-repeated")
    # of each shard the ends of its run, which may go on at the shard's first document, and what is cut there
    cut = F.when(F.size("cuts") > 0, F.struct("place", "full", "cuts"))
    ends = rows.groupBy("source", "shard").agg(F.first("passes").alias("passes"), F.min(F.when(F.col("in_1"), F.col("place"))).alias("first"), F.max(F.when(F.col("in_1"), F.col("place"))).alias("last"), F.max(F.when(F.col("in_2"), F.col("place"))).alias("again"), F.collect_list(cut).alias("cut"))
    ends = materialize(ends, "mix-ends")

    named = {"source": "__source", "doc_id": "__id", "mark": "__mark"}
    own = keyed.filter(F.col("__text").rlike(WORD))
    parts = []
    if not repeated.isEmpty():
        some = join_small(own, repeated.withColumnsRenamed(named | {"full": "__full", "cuts": "__cuts"}), list(named.values()), "inner", spread=F.col("__mark"))
        parts.append(_taken_texts(some.dropDuplicates(list(named.values())), docs.columns))
        flags = repeated.select(*key, F.lit(True).alias("__repeated")).withColumnsRenamed(named)
        own = join_small(own, flags, list(named.values()), "left", spread=F.col("__mark")).filter("__repeated is null").drop("__repeated")
    # the helpers of the order go by the names of ids
    placed = own.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "__text", F.col("__source").alias("source"), F.col("__id").alias("doc_id"), F.col("__mark").alias("mark"))
    placed = join_small(placed, sources.select("source", "n_shards"), ["source"], "inner", spread=F.col("mark")).withColumn("shard", shard_of(seed))
    placed = join_small(placed, ends, ["source", "shard"], "inner", spread=F.col("mark")).withColumn("place", place_of(seed))
    inside = F.coalesce((F.col("place") >= F.col("first")) & (F.col("place") <= F.col("last")), F.lit(False)).cast("int") + F.coalesce(F.col("place") <= F.col("again"), F.lit(False)).cast("int")
    placed = placed.withColumn("here", F.get(F.filter("cut", lambda c: c["place"] == F.col("place")), F.lit(0)))
    placed = placed.withColumn("full", F.coalesce("here.full", F.col("passes") + inside)).withColumn("cuts", F.coalesce("here.cuts", F.expr(f"cast(array() as {_SPAN})")))
    out = _taken_texts(placed.select("__row.*", "__text", F.col("full").alias("__full"), F.col("cuts").alias("__cuts")), docs.columns)
    for part in parts:
        out = out.unionByName(part)
    return out
