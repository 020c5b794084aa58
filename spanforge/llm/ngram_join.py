"""N-gram Jaccard join (operator 8): MinHash banding, candidates checked by sketches, full n-gram sets compared.

Documents with the same n-gram set are one class from the start, so that copies are neither banded
nor compared. Classes that share a band hash meet their bucket's least one, its head, and are linked
to it if a sketch of one bit for each MinHash value allows; those that differ from the head meet the
others of the bucket in blocks, where sketches decide again. Components of these links are candidate
clusters, so that chance collisions join nothing up: each text goes to its cluster once, not once
for each band. A large cluster is compared in pairs of blocks, in tasks of their own; only counts
and spanning edges leave a block, never its pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import join_small, key_slices, materialize, text_slices, wanted
from spanforge.llm.components import components
from spanforge.llm.words import mix, shingles, words_of

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: n-grams and members of one block of a cluster, at most (but for a single text with more).
BLOCK_GRAMS, BLOCK_MEMBERS = 1_000_000, 128
#: Bits of a sketch, at most, and by how many of them a set may differ from its bucket's head to need no look at the others.
SKETCH_BITS, INNER_BITS = 128, 4


def bands_for(threshold: float, recall: float, most_hashes: int = 160) -> tuple[int, int]:
    """Bands and rows: the most rows (so the fewest false candidates) whose recall at ``threshold`` is met within ``most_hashes`` hashes."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach this recall")
    return best


def most_differing(threshold: float, bits: int) -> int:
    """Bits in which the sketches of two sets differ that are ``threshold`` similar: 4.6 standard deviations above the mean, exceeded about once in 100,000 times."""
    p = (1 - threshold) / 2
    return math.floor(bits * p + 4.6 * math.sqrt(bits * p * (1 - p)))


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-gram hashes, their offsets by row, and whether each is the first of its kind in its row."""
    words = words_of(texts)
    grams, offsets = shingles(words, words.hashes(), n)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(offsets))
    key = mix(grams + row * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(key, kind="stable")
    first = np.ones(len(grams), bool)
    first[by[1:][key[by][1:] == key[by][:-1]]] = False
    return grams, offsets, first


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _set_ids(grams: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """For each row a 16-byte id of its n-gram set (null if empty), and the set's size."""
    size = _sums(first.astype(np.int64), offsets)
    pair = np.empty((len(size), 2), np.uint64)
    for i in (0, 1):
        pair[:, i] = mix(_sums(np.where(first, mix(grams + np.uint64(i + 11)), np.uint64(0)), offsets) + size.astype(np.uint64))
    raw = pa.Array.from_buffers(pa.binary(16), len(size), [None, pa.py_buffer(pair.tobytes())])
    return pa.array([None if s == 0 else v.as_py() for s, v in zip(size.tolist(), raw, strict=True)], pa.binary()), size


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """For each row of ``docs``: doc_id, mark, sid (id of the n-gram set, null without words), n_grams, its band hashes and its sketch (s1, s2: a bit of each of the first MinHash values)."""
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            grams, offsets, first = _sets(part.column("text"), n)
            sid, size = _set_ids(grams, offsets, first)
            full = np.flatnonzero(np.diff(offsets))
            out, sketch = np.zeros((len(full), bands), np.uint64), np.zeros((part.num_rows, 2), np.uint64)
            if len(full):
                for b in range(bands):
                    total = np.full(len(full), b + 1, np.uint64)
                    for r in range(rows):
                        hashed = grams * factors[b * rows + r]
                        hashed ^= hashed >> np.uint64(32)
                        hashed *= factors[b * rows + r]
                        least = np.minimum.reduceat(hashed, offsets[full])
                        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + least)
                        if (bit := b * rows + r) < SKETCH_BITS:
                            sketch[full, bit // 64] |= (least >> np.uint64(20) & np.uint64(1)) << np.uint64(bit % 64)
                    out[:, b] = total
            lengths = np.where(np.diff(offsets) > 0, bands, 0)
            hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(out.view(np.int64).ravel()))
            s1, s2 = (pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), sid, pa.array(size), hashes, s1, s2], ["doc_id", "mark", "sid", "n_grams", "bands", "s1", "s2"])

    return docs.withColumn("mark", F.xxhash64("text")).mapInArrow(run, "doc_id long, mark long, sid binary, n_grams long, bands array<long>, s1 long, s2 long")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """``rows`` (block, n_blocks) once for each pair (a, b) of blocks that theirs is in."""
    other = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda j: F.struct(F.least("block", j).alias("a"), F.greatest("block", j).alias("b")))
    return rows.withColumn("pair", F.explode(other)).select("*", "pair.a", "pair.b").drop("pair")


def _near_links(rows: DataFrame, most: int) -> DataFrame:
    """Of ``rows`` (h, a, b, block, sid, s1, s2), in order of pairs of blocks and then sid: edges (a, b) that join up those whose sketches differ in ``most`` bits or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, first, second), parts in itertools.groupby(key_slices(batches, ["h", "a", "b"]), lambda x: x[0]):
            group = pa.Table.from_batches([part for _, part in parts])
            s1, s2, block = (group.column(c).to_numpy() for c in ("s1", "s2", "block"))
            linked = np.bitwise_count(s1[:, None] ^ s1[None, :]) + np.bitwise_count(s2[:, None] ^ s2[None, :]) <= most
            np.fill_diagonal(linked, False)
            if first != second:
                linked &= block[:, None] != block[None, :]
            label = _labels(linked)
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                sid = group.column("sid").combine_chunks()
                yield pa.RecordBatch.from_arrays([sid.take(pa.array(moved)), sid.take(pa.array(label[moved]))], ["a", "b"])

    return rows.select("h", "a", "b", "block", "sid", "s1", "s2").mapInArrow(run, "a binary, b binary")


def candidate_links(sets: DataFrame, threshold: float, bits: int, block_members: int) -> DataFrame:
    """Edges (a, b) between ``sets`` (sid, bands, s1, s2), whose components hold together all pairs that share a band and whose sketches differ little enough.

    Differences of sketches are a metric. A set that differs from its bucket's head in INNER_BITS or
    fewer can only be near to sets that differ from the head in as many more: linking those to the
    head keeps such pairs. What is farther from the head meets all of the bucket but such inner sets.
    """
    most = most_differing(threshold, bits)
    banded = sets.select("sid", "s1", "s2", F.explode("bands").alias("h"))
    heads = materialize(banded.groupBy("h").agg(F.min(F.struct("sid", "s1", "s2")).alias("head"), F.count("*").alias("n")).filter("n > 1").select("h", "head"), "heads")
    away = F.bit_count(F.col("s1").bitwiseXOR(F.col("head.s1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("head.s2")))
    met = banded.join(heads, "h").filter(F.col("sid") != F.col("head.sid")).withColumn("away", away)
    outer = F.col("away") > INNER_BITS
    met = materialize(met.select("sid", F.col("head.sid").alias("head"), "away", *[F.when(outer, F.col(c)).alias(c) for c in ("h", "s1", "s2")]), "met")
    links = met.filter(F.col("away") <= most + INNER_BITS).select(F.col("sid").alias("a"), F.col("head").alias("b"))
    counts = met.filter(outer).groupBy("h").agg(F.count("*").alias("n"), F.max("away").alias("farthest"))
    unmet = materialize(counts.filter((F.col("n") > 1) & (F.col("farthest") > most + INNER_BITS)).select("h", F.ceil(F.col("n") / block_members).cast("int").alias("n_blocks")), "unmet")
    if unmet.isEmpty():
        return links
    rest = met.filter(outer).join(unmet, "h").withColumn("block", F.pmod(F.xxhash64("sid"), "n_blocks").cast("int"))
    return links.union(_near_links(_block_pairs(rest).repartition("h", "a", "b").sortWithinPartitions("h", "a", "b", "sid"), most))


def overlaps(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all pairs of ``sets`` (each without repeats)."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    common = np.zeros((m, m), np.float32)
    edges = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))
    for start, (a, b) in zip(range(0, int(shared.sum()), width), itertools.pairwise(edges), strict=False):
        cells = np.zeros((m, width), np.float32)
        cells[row[a:b], column[a:b] - start] = 1
        common += cells @ cells.T
    return common.astype(np.int64)


def _labels(linked: np.ndarray) -> np.ndarray:
    """The least member of each member's component, by a matrix of links."""
    m = len(linked)
    label = np.arange(m)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], m).min(axis=1, initial=m))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _compare(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """``members`` (cluster, n_blocks, a, b, block, sid, copies, text) in order of block pairs -> sid, links to other sets in this pair of blocks (copies counted), and a sid of its component there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in text_slices(batches, limit=1 << 22):
            grams, offsets, first = _sets(part.column("text"), n)
            other = [part.column(c).to_pylist() for c in ("cluster", "n_blocks", "a", "b", "block", "sid", "copies")]
            for i, values in enumerate(zip(*other, strict=True)):
                at = slice(offsets[i], offsets[i + 1])
                yield values, grams[at][first[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (_, n_blocks, a, b), found in itertools.groupby(rows(batches), lambda x: x[0][:4]):
            group = list(found)
            sets = [g for _, g in group]
            sid, copies = [v[5] for v, _ in group], np.array([v[6] for v, _ in group], np.int64)
            common, size = overlaps(sets), np.array([len(s) for s in sets])
            linked = common * (1 + threshold) + 1e-9 >= threshold * (size[:, None] + size[None, :])
            np.fill_diagonal(linked, False)
            if a != b:
                block = np.array([v[4] for v, _ in group])
                linked &= block[:, None] != block[None, :]
            links, label = linked @ copies, _labels(linked)
            out += [(sid[i], int(links[i]), sid[label[i]], n_blocks) for i in range(len(group))]
            if len(out) > 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary(), pa.int32()), strict=True)], ["sid", "links", "near", "n_blocks"])

    return members.mapInArrow(run, "sid binary, links long, near binary, n_blocks int")


def jaccard_join(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, class_id (the least doc_id of its class) and n_links.

    Two rows are linked if the Jaccard similarity of their sets of ``n`` words in sequence is
    ``threshold`` or more; n_links counts a row's links to all other rows, copies included, and
    classes are the components of the links. A text of fewer than ``n`` words, but one, has one
    n-gram of all its words; a null, empty or blank text has none, so no links and its own class.
    Rows with a null doc_id take part; a class of only such rows has a null class_id. Repeated rows
    count as copies. Other columns are ignored; an empty table gives no rows. A pair that shares no
    band is missed, with a probability of at most 1 - ``recall`` at the threshold and less above it.
    """
    rows = _linked(wanted(docs, {"doc_id": "long", "text": "string"}), n, threshold, recall)
    return rows.select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _linked(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """doc_id, mark (a hash of the text), root, class_id and n_links of each row; the last three are null for a row without links."""
    bands, rows = bands_for(threshold, recall)
    signed = materialize(signatures(docs, n, bands, rows), "signed")
    # the representative is the row with the least doc_id, null last
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    same = ("n_grams", "bands", "s1", "s2")
    sets = signed.filter("sid is not null").groupBy("sid").agg(F.count("*").alias("copies"), least_row.alias("row"), *[F.first(c).alias(c) for c in same])
    sets = materialize(sets.select("sid", "copies", F.col("row.doc_id").alias("first"), F.col("row.mark").alias("mark"), *same), "sets")
    clusters = components(candidate_links(sets, threshold, min(SKETCH_BITS, bands * rows), BLOCK_MEMBERS))
    clusters = materialize(clusters.select(F.col("node").alias("sid"), F.col("root").alias("cluster")).join(sets.drop("bands", "s1", "s2"), "sid"), "clusters")
    n_blocks = F.ceil(F.greatest(F.sum("n_grams") / BLOCK_GRAMS, F.count("*") / BLOCK_MEMBERS)).cast("int")
    wide = materialize(clusters.groupBy("cluster").agg(n_blocks.alias("n_blocks")).filter("n_blocks > 1"), "wide")
    members = join_small(clusters, wide, ["cluster"], "left", spread=F.col("sid")).withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    members = materialize(members.withColumn("block", F.pmod(F.xxhash64("sid"), "n_blocks").cast("int")), "members")

    # a set meets the rows with its representative's id and text, whatever else has that id
    chosen = members.select("sid", "first", "mark", "cluster", "copies", "n_blocks", "block")
    marked = docs.withColumnRenamed("doc_id", "first").withColumn("mark", F.xxhash64("text"))
    found = join_small(marked, chosen, ["first", "mark"], "inner", spread=F.monotonically_increasing_id(), sift=True)
    paired = _block_pairs(_of_set(found, n).dropDuplicates(["sid"])).select("cluster", "n_blocks", "a", "b", "block", "sid", "copies", "text")
    compared = materialize(_compare(paired.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "n_blocks", "a", "b", "sid"), n, threshold), "compared")

    links = compared.groupBy("sid").agg(F.sum("links").alias("links"), F.min("near").alias("near"))
    if wide.isEmpty():
        rooted = links.withColumnRenamed("near", "root")
    else:
        joined = components(compared.filter("n_blocks > 1").select(F.col("sid").alias("a"), F.col("near").alias("b")))
        rooted = links.join(joined.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "links", F.coalesce("root", "near").alias("root"))
    shared = sets.select("sid", "copies", "first").join(rooted, "sid", "left").filter("copies > 1 or links > 0")
    shared = materialize(shared.select("sid", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "sid").alias("root")), "shared")
    least = shared.groupBy("root").agg(F.min("first").alias("class_id"))
    final = materialize(join_small(shared, least, ["root"], "inner", spread=F.col("sid")).select("sid", "root", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links")), "classes")
    return join_small(signed.select("doc_id", "mark", "sid"), final, ["sid"], "left", spread=F.col("doc_id")).drop("sid")


def _of_set(found: DataFrame, n: int) -> DataFrame:
    """The rows of ``found`` whose text has the n-gram set that their sid names."""
    columns = ["text", "sid", "cluster", "copies", "n_blocks", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            own, _ = _set_ids(*_sets(part.column("text"), n))
            yield part.filter(pa.array([a == b for a, b in zip(own.to_pylist(), part.column("sid").to_pylist(), strict=True)], pa.bool_()))

    found = found.select(*columns)
    return found.mapInArrow(run, found.schema)


def keep_one(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` without near duplicates, with all columns: of each class the row with the least doc_id (null last), once. Rows without links stay."""
    linked = _linked(wanted(docs, {"doc_id": "long", "text": "string"}), n, threshold, recall).filter("root is not null").select("doc_id", "mark", "root")
    linked = materialize(linked.withColumn("key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")), "linked")
    winners = linked.groupBy("root").agg(F.min("key").alias("winner"))
    decided = join_small(linked, winners, ["root"], "inner", spread=F.col("mark")).groupBy("doc_id", "mark").agg(F.max(F.col("key") == F.col("winner")).alias("__stays"), F.count("*").alias("__rows"))
    decided = materialize(decided, "decided")
    marked = docs.withColumn("__mark", F.xxhash64(F.col("text").cast("string"))).withColumn("__id", F.col("doc_id").cast("long"))
    kept = join_small(marked, decided.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"}), ["__id", "__mark"], "left", spread=F.col("__mark"), sift=True).filter("__stays is null or __stays")
    out = kept.filter("__stays is null or __rows = 1")
    if not decided.filter("__stays and __rows > 1").isEmpty():  # the same row more than once
        out = out.unionByName(kept.filter("__stays and __rows > 1").dropDuplicates(["__id", "__mark"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
