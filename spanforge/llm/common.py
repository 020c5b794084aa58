"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import itertools
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many rows and bytes a table is broadcast: the driver holds it several times over while it is sent.
SMALL_ROWS, SMALL_BYTES = 50_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Only a local session without one (tests) gets a
    folder of its own, which goes when Python ends; on several machines each would write to its own
    disk, so there a session without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``clean_up`` removes."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, computed once.

    A lost executor costs no more than the tasks it ran, as the files outlive it. They stay until
    ``clean_up`` is called.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Remove what this process has written to the shared folder so far, archives included; how many paths.

    To be called when results are written out: until then they may still read those files.
    """
    done = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", *, spread: Column, at_most: int | None = None, salts: int = 16, sift: bool = False) -> DataFrame:
    """Null-safe equi-join of ``big`` with ``small``, which has one row for each key.

    ``small`` is measured first, in rows and in bytes (as JSON text): up to SMALL_ROWS and
    SMALL_BYTES it is broadcast. ``at_most`` is a bound of its rows that the caller knows, which
    spares the measuring where rows are a few numbers wide. Beyond that both sides are shuffled,
    ``big`` salted by ``spread`` and ``small`` repeated ``salts`` times, so that a key with a third
    of the rows is dealt over many tasks. ``sift``: rows of ``big`` that a sieve of ``small``'s keys
    rules out aren't shuffled, for wide rows few of which are met; it runs in Python.
    """
    keys = [f"__k{i}" for i in range(len(on))]
    for k, c in zip(keys, on, strict=True):
        small = small.withColumnRenamed(c, k)
    if (at_most <= SMALL_ROWS) if at_most is not None else _fits(small):
        same = [big[c].eqNullSafe(F.col(k)) for c, k in zip(on, keys, strict=True)]
        return big.join(F.broadcast(small), same, how).drop(*keys)
    rest = None
    if sift:
        passes = in_sieve(sieve(small, F.xxhash64(*keys), "keys"))(F.xxhash64(*on))
        rest, big = big.filter(~passes) if how == "left" else None, big.filter(passes)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = [salted[c].eqNullSafe(F.col(k)) for c, k in zip(on, keys, strict=True)]
    # Spark's guess of the copies' size leaves the copying out
    out = salted.join(copies.hint("merge"), [salted["__salt"] == F.col("__copy"), *same], how).drop("__salt", "__copy", *keys)
    return out if rest is None else out.unionByName(rest, allowMissingColumns=True)


def _fits(small: DataFrame) -> bool:
    width = F.length(F.to_json(F.struct(*[F.col(c) for c in small.columns]))).cast("long")
    found = small.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return found.rows <= SMALL_ROWS and found.bytes <= SMALL_BYTES


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece has ``limit`` bytes of text, or one row; null texts become empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = pc.fill_null(batch.column(at), "").cast(pa.string())
        batch = batch.set_column(at, pa.field(column, pa.string()), texts)
        ends = pc.cumulative_sum(pc.cast(pc.binary_length(texts), pa.int64())).to_numpy(zero_copy_only=False)
        start, base = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(ends.searchsorted(base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, ends[stop - 1]


def key_slices(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows in sequence with equal ``keys`` as (keys, slice): a slice ends with its batch, so that a long sequence comes in several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for start, stop in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield tuple(c[start].item() for c in columns), batch.slice(start, stop - start)


def small_batches(spark: SparkSession) -> None:
    """Records go to Python in batches of 1000 instead of the default 10,000, unless the session says otherwise.

    A batch of texts is held whole by Spark and by the Python worker; long texts make ten thousand
    of them the largest thing in an executor's memory.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def wanted(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Just ``columns`` of ``df``, cast to the types given: extra columns can't clash with an operator's own."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


#: Slots of a sieve: 64 bits each, so that it has 8 MB of bits whatever the number of keys.
SLOTS = 1 << 20


def _slot_and_bits(key: Column) -> tuple[Column, Column]:
    """Where a 64-bit hash stands in a sieve, and the four bits that it sets there."""
    steps = [F.shiftrightunsigned(key, 20 + 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4)]
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, s) for s in steps]
    return key.bitwiseAND(F.lit(SLOTS - 1)), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def sieve(keys: DataFrame, key: Column, name: str) -> DataFrame:
    """A Bloom filter over ``key`` (64-bit hashes) as a written table (slot, bits) of SLOTS rows at most.

    Its size is fixed. With many keys it lets more pass that isn't among them, down to all, but it
    never holds back one that is; whoever uses it checks what passes.
    """
    slot, bits = _slot_and_bits(key)
    return materialize(keys.select(slot.alias("slot"), bits.alias("bits")).groupBy("slot").agg(F.bit_or("bits").alias("bits")), name)


def sifted(big: DataFrame, key: Column, passing: DataFrame) -> DataFrame:
    """The rows of ``big`` whose ``key`` may be in the sieve ``passing``, which is broadcast: its size is bounded by SLOTS."""
    slot, bits = _slot_and_bits(key)
    own = big.withColumn("__slot", slot).withColumn("__own", bits)
    met = own.join(F.broadcast(passing.withColumnsRenamed({"slot": "__at", "bits": "__bits"})), F.col("__slot") == F.col("__at"))
    return met.filter(F.col("__bits").bitwiseAND(F.col("__own")) == F.col("__own")).select(*[F.col(f"`{c}`") for c in big.columns])


def packed(passing: DataFrame) -> np.ndarray:
    """A sieve as an array. Tasks put its slots together, so that 8 MB at most, deflated, come to the driver, and no row for each slot."""
    width = SLOTS >> 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            slots, bits = batch.column("slot").to_numpy(), batch.column("bits").to_numpy().view(np.uint64)
            for part in np.unique(slots // width).tolist():
                here = slots // width == part
                own.setdefault(part, np.zeros(width, np.uint64))[slots[here] % width] = bits[here]
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in own.values()], pa.binary())], ["part", "bits"])

    out = np.zeros(SLOTS, np.uint64)
    for r in passing.repartition(16, F.shiftright("slot", 16)).mapInArrow(run, "part int, bits binary").collect():
        out[r.part * width : (r.part + 1) * width] |= np.frombuffer(zlib.decompress(r.bits), np.uint64)
    return out


def in_packed(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` may be in a packed sieve."""
    own = np.zeros(len(keys), np.uint64)
    for i in range(4):
        own |= np.uint64(1) << (keys >> np.uint64(20 + 6 * i) & np.uint64(63))
    return bits[(keys & np.uint64(SLOTS - 1)).astype(np.int64)] & own == own


def in_sieve(keys: DataFrame) -> Callable[[Column], Column]:
    """Whether a 64-bit hash, not null, may be in the sieve ``keys``, told in Python: only its bits are broadcast, not a row for each slot."""
    sent = keys.sparkSession.sparkContext.broadcast(packed(keys))

    @F.arrow_udf(BooleanType())
    def told(key: pa.Array) -> pa.Array:
        return pa.array(in_packed(sent.value, key.to_numpy(zero_copy_only=False).view(np.uint64)))

    return told
