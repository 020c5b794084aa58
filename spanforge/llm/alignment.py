"""Cross-tokenizer alignment (operator 13): elementary intervals between the token ends of two tokenizers.

Both tokenizers cover the same bytes, a space and the text. The sorted union of their token ends cuts
the bytes into elementary intervals; each lies in one token of either kind, which a binary search in
the ends finds, and is one overlap of the two: a link. Where both have an end, a group of tokens is
closed; the product of a group's two sides is what it expands to.

Texts are cut where both tokenizers surely begin a token, before a space between two other than white
space, and the units between are encoded and aligned once for each task and then put together again.
Corpus-wide counts of linked id pairs come from partial counts of each task. The most frequent
pairs, up to HEAD of them, go to all tasks; the others, so none that a large part of the documents
has, meet their counts by a join. Both ways are always taken.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, text_slices, wanted

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs of ids whose counts go to all tasks, at most: 16 MB.
HEAD = 1 << 20
#: Units a task remembers, and links of them, before it starts anew; pairs it gathers before it counts them.
_CACHED, _LINKS, _PAIRS = 300_000, 8_000_000, 3_000_000
#: Characters of units that are encoded as one text.
_TOGETHER = 20_000
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ODD = re.compile(r"\s | \s| \Z")


@dataclass
class Sides:
    """The two tokenizers as their files' contents, which tasks load, and the bytes of their tokens."""

    a_file: str
    b_file: bytes
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    cuts: bool  # whether texts may be cut into units

    def encoders(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core, not all of them
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(self.a_file)
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_proto=self.b_file)
        fast = getattr(a, "encode_batch_fast", a.encode_batch)  # without places in the text
        return lambda texts: [e.ids for e in fast(texts, add_special_tokens=False)], lambda texts: b.encode(texts, num_threads=1)


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level entry stands for: printable Latin-1 characters stand for themselves, the others in order for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(a_path: str = BYTE_BPE, b_path: str = PIECES) -> Sides:
    """Both files, read on the driver once; their size is the vocabularies'."""
    import sentencepiece

    with open(a_path, encoding="utf-8") as f:
        a_file = f.read()
    with open(b_path, "rb") as f:
        b_file = f.read()
    known, sign = json.loads(a_file), byte_of_sign()
    entries = known["model"]["vocab"] | {t["content"]: t["id"] for t in known["added_tokens"]}
    a_bytes = [b""] * (max(entries.values()) + 1)
    for text, i in entries.items():
        a_bytes[i] = bytes(sign[c] for c in text) if all(c in sign for c in text) else text.encode()
    sp = sentencepiece.SentencePieceProcessor(model_proto=b_file)
    names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    b_bytes = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    before = known.get("pre_tokenizer") or {}
    cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not known.get("normalizer")
    return Sides(a_file, b_file, a_bytes, b_bytes, bool(cuts) and not any("▁" in n.lstrip("▁") for n in names))


def elementary(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the elementary intervals, the places of the tokens of either side that each is in, and whether it closes a group. Both sides end at the same byte."""
    ends = np.union1d(ends_a, ends_b)
    of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, of_a, of_b, (ends_a[of_a] == ends) & (ends_b[of_b] == ends)


class Aligner:
    """Aligns texts by their units, and keeps those it has met, up to a number."""

    def __init__(self, sides: Sides):
        self.sides, (self.encode_a, self.encode_b) = sides, sides.encoders()
        self.size_a, self.size_b = (np.array([len(b) for b in x], np.int64) for x in (sides.a_bytes, sides.b_bytes))
        self.names = list(map(str, range(max(len(self.size_a), len(self.size_b)))))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A and of B, groups, links; all zero if the bytes differ
        self.a, self.b, self.offsets = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _texts(self, units: list[str]) -> list[str]:
        """``units`` in order, as few texts that are cut into them again: only where neither white space nor an end meets another may they be put together."""
        out, size = [[]], 0
        for u in units:
            loose = not self.sides.cuts or not u or u[0].isspace() or u[-1].isspace()
            if out[-1] and (loose or size > _TOGETHER):
                out.append([])
                size = 0
            out[-1].append(u)
            size = size + len(u) if not loose else _TOGETHER + 1
        return [" ".join(x) for x in out if x]

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides in a row, how many each unit has, and which units' bytes both sides hold."""
        texts = self._texts(units)
        raw = [b" " + u.encode() for u in units]
        ends = np.cumsum([len(r) for r in raw])
        ids, counts, whole = [], [], b"".join(raw)
        for found, size, held in ((self.encode_a([" " + t for t in texts]), self.size_a, self.sides.a_bytes), (self.encode_b(texts), self.size_b, self.sides.b_bytes)):
            flat = np.fromiter(itertools.chain.from_iterable(found), np.int32)
            upto = np.searchsorted(np.cumsum(size[flat]), ends, side="right")
            if b"".join(map(held.__getitem__, flat.tolist())) != whole or (np.cumsum(size[flat])[upto - 1] != ends).any():
                return self._one_by_one(units, raw)
            ids.append(flat)
            counts.append(np.diff(upto, prepend=0))
        return *ids, *counts, np.ones(len(units), bool)

    def _one_by_one(self, units: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``_ids``, where the bytes of some unit aren't held."""
        a, b = self.encode_a([" " + u for u in units]), self.encode_b(units)
        good = np.ones(len(units), bool)
        for i, (r, x, y) in enumerate(zip(raw, a, b, strict=True)):
            if b"".join(map(self.sides.a_bytes.__getitem__, x)) != r or b"".join(map(self.sides.b_bytes.__getitem__, y)) != r:
                good[i], a[i], b[i] = False, [], []
        return *(np.fromiter(itertools.chain.from_iterable(x), np.int32) for x in (a, b)), *(np.array([len(y) for y in x], np.int64) for x in (a, b)), good

    def _learn(self, units: list[str]) -> None:
        a, b, n_a, n_b, good = self._ids(units)
        ends, of_a, of_b, closes = elementary(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
        unit = np.searchsorted(upto_a, of_a, side="right")
        links = np.bincount(unit, minlength=len(units))
        numbers = np.stack([n_a, n_b, np.bincount(unit[closes], minlength=len(units)), links], axis=1)
        # a group's tokens are those after the last group's up to its own last ones
        last_a, last_b = of_a[closes] + 1, of_b[closes] + 1
        name_a, name_b = list(map(self.names.__getitem__, a.tolist())), list(map(self.names.__getitem__, b.tolist()))
        sides = zip(itertools.pairwise([0, *last_a.tolist()]), itertools.pairwise([0, *last_b.tolist()]), strict=True)
        text = [f"{name_a[i]}|{name_b[k]}" if j - i == m - k == 1 else f"{','.join(name_a[i:j])}|{','.join(name_b[k:m])}" for (i, j), (k, m) in sides]
        bounds = np.concatenate([[0], np.cumsum(numbers[:, 2])]).tolist()
        self.place.update(zip(units, itertools.count(len(self.place))))
        self.groups += [";".join(text[i:j]) for i, j in itertools.pairwise(bounds)]
        self.numbers = np.concatenate([self.numbers, np.where(good[:, None], numbers, -1)])
        self.a, self.b = np.concatenate([self.a, a[of_a]]), np.concatenate([self.b, b[of_b]])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(links)])

    def units(self, text: str) -> list[str]:
        """The units of a space and the text, each without the space it begins with."""
        if not text:
            return []
        whole = " " + text
        if not self.sides.cuts:
            return [text]
        if _ODD.search(whole):
            return [u[1:] for u in _CUT.split(whole)]
        return text.split(" ")

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """For each text the four numbers, and the places of its units; no units for a text whose bytes a side doesn't hold."""
        cut = [self.units(t) for t in texts]
        if len(self.place) > _CACHED or len(self.a) > _LINKS:
            self._forget()
        if new := list(dict.fromkeys(u for x in cut for u in x if u not in self.place)):
            self._learn(new)
        places = [list(map(self.place.__getitem__, x)) for x in cut]
        numbers = np.zeros((len(texts), 4), np.int64)
        for i, p in enumerate(places):
            own = self.numbers[p]
            if (own < 0).any():
                places[i] = []
            else:
                numbers[i] = own.sum(axis=0)
        return numbers, places

    def links(self, places: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, a, b) in order, and how many links of the text each stands for."""
        flat = np.fromiter(itertools.chain.from_iterable(places), np.int64)
        row = np.repeat(np.arange(len(places)), [len(p) for p in places])
        size = self.offsets[flat + 1] - self.offsets[flat]
        at = np.arange(size.sum()) + np.repeat(self.offsets[flat] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(flat) else flat, size)
        n_b = len(self.size_b)
        pair = self.a[at].astype(np.int64) * n_b + self.b[at]
        distinct, count = np.unique(np.repeat(row, size) * (len(self.size_a) * n_b) + pair, return_counts=True)
        row, pair = np.divmod(distinct, len(self.size_a) * n_b)
        return row, pair // n_b, pair % n_b, count


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, sides: Sides) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): the four numbers, groups_sha256, and its distinct linked id pairs as arrays a, b and n (links of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(sides)
        for part in text_slices(batches):
            numbers, places = aligner.align(part.column("text").to_pylist())
            row, a, b, n = aligner.links(places)
            ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (a, b, n)]
            digests = [hashlib.sha256(";".join(map(aligner.groups.__getitem__, p)).encode()).hexdigest() if p else "" for p in places]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(numbers[:, i]) for i in range(4)], pa.array(digests, pa.string()), *lists], ["doc_id", *_NUMBERS, "groups_sha256", "a", "b", "n"])

    return docs.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>")


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(a, b, docs): how many of ``rows`` (arrays a, b of distinct pairs) hold each pair; tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair // n_b, pa.int32()), pa.array(pair % n_b, pa.int32()), pa.array(n)], ["a", "b", "docs"])

        held, size = [], 0
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
            held.append(a * n_b + b)
            size += len(a)
            if size > _PAIRS:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    return rows.select("a", "b").mapInArrow(run, "a int, b int, docs long").groupBy("a", "b").agg(F.sum("docs").alias("docs"))


def _head_from(counts: DataFrame, head: int) -> int:
    """The least power of two (or 0) such that at most ``head`` pairs have so many documents or more."""
    sizes = {r.bits: r.n for r in counts.groupBy(F.length(F.bin("docs")).alias("bits")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    total, least = 0, 64
    for bits in sorted(sizes, reverse=True):
        if (total := total + sizes[bits]) > head:
            break
        least = bits
    else:
        least = 1
    return 0 if least == 1 else min(1 << (least - 1), (1 << 63) - 1)


def _tallied(rows: DataFrame, counts: DataFrame, least: int, n_b: int) -> DataFrame:
    """``rows`` with n_best and count_sum over the pairs of at least ``least`` documents, and the arrays cut down to the others."""
    table = counts.filter(F.col("docs") >= least).select((F.col("a").cast("long") * n_b + F.col("b")).alias("pair"), "docs", "best").toArrow()  # HEAD rows at most
    pair, docs, best = (table.column(c).to_numpy() for c in ("pair", "docs", "best"))
    by = np.argsort(pair)
    pair, docs, best = np.append(pair[by], -1), np.append(docs[by], 0), np.append(best[by], False)
    names = [c for c in rows.columns if c not in ("a", "b", "n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("a", "b", "n")]
            length = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False)
            a, b, n = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            own = a * n_b + b
            at = np.searchsorted(pair[:-1], own)
            hit = pair[at] == own
            sums = [np.concatenate([[0], np.cumsum(np.where(hit, n * x[at], 0))]) for x in (best.astype(np.int64), docs)]
            ends = np.concatenate([[0], np.cumsum(length)])
            missed = np.concatenate([[0], np.cumsum(~hit)])[ends]
            rest = [pa.ListArray.from_arrays(pa.array(missed, pa.int32()), pa.array(x[~hit], pa.int32())) for x in (a, b, n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(np.diff(s[ends])) for s in sums], *rest], [*names, "n_best", "count_sum", "a", "b", "n"])

    kept = ", ".join(f"{c} {t}" for c, t in rows.select(*names).dtypes)
    return rows.mapInArrow(run, f"{kept}, n_best long, count_sum long, a array<int>, b array<int>, n array<int>")


def align_tokens(docs: DataFrame, *, a_path: str = BYTE_BPE, b_path: str = PIECES, head: int = HEAD) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): how the tokens of a byte-level BPE (A) and of a piece model (B) lie to each other.

    n_a, n_b: tokens of a space and the text; n_groups: spans between ends that both have; n_links:
    pairs of tokens whose bytes overlap; n_best: those of them whose id pair is linked in the most
    rows of all that hold the A id, ties included; count_sum: the sum over links of the number of rows
    that hold the link's id pair; groups_sha256: hash of `a1,a2|b1;a3|b2,b3`, the ids by group. A
    text that is null, empty or not given back by both sides (such as one with U+2581) has zeros and
    an empty groups_sha256. Null and repeated doc_ids stay as they are, each row counts; other columns
    are ignored; an empty table gives no rows. Memory follows the longest run without a cut.
    """
    sides = load(a_path, b_path)
    n_b = len(sides.b_bytes)
    rows = materialize(aligned(wanted(docs, {"doc_id": "long", "text": "string"}), sides).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(rows, n_b), "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # a row for each id of A at most: its vocabulary
    counts = materialize(counts.join(F.broadcast(most), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")), "counts")
    least = _head_from(counts, head)
    tallied = materialize(_tallied(rows, counts, least, n_b), "tallied")
    rare = tallied.select("row", F.inline(F.arrays_zip("a", "b", "n"))).join(counts.filter(F.col("docs") < least), ["a", "b"])
    rest = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n").cast("long")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("docs")).alias("more_sum"))
    out = tallied.drop("a", "b", "n").join(materialize(rest, "rest"), "row", "left")
    total = [(F.col(c) + F.coalesce(m, F.lit(0))).cast("long").alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return out.select("doc_id", *_NUMBERS, *total, "groups_sha256")


def alignments(docs: DataFrame, *, a_path: str = BYTE_BPE, b_path: str = PIECES) -> DataFrame:
    """doc_id, start and stop (byte offsets in a space and the text), a_ids and b_ids for each group of each row of ``docs``, and pairs: the product of its two sides. Rows without tokens have no groups."""
    sides = load(a_path, b_path)
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(sides)
        for part in text_slices(batches):
            for doc_id, text in zip(part.column("doc_id"), part.column("text").to_pylist(), strict=True):
                a, b, _, _, good = aligner._ids([text]) if text else (*[np.zeros(0, np.int32)] * 4, np.zeros(1, bool))
                if not good[0]:
                    continue
                ends, of_a, of_b, closes = elementary(np.cumsum(aligner.size_a[a]), np.cumsum(aligner.size_b[b]))
                stop = ends[closes]
                cut_a, cut_b = (np.concatenate([[0], of[closes] + 1]) for of in (of_a, of_b))
                n_a, n_b = np.diff(cut_a), np.diff(cut_b)
                size = n_a * n_b
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                wide = np.repeat(n_b, size)
                left, right = a[np.repeat(cut_a[:-1], size) + within // wide], b[np.repeat(cut_b[:-1], size) + within % wide]
                products = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32())], fields=list(pair)))
                ids = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32())) for cut, x in ((cut_a, a), (cut_b, b))]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(stop), pa.int64()), pa.array(np.concatenate([[0], stop[:-1]])), pa.array(stop), *ids, products], ["doc_id", "start", "stop", "a_ids", "b_ids", "pairs"])

    return wanted(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, "doc_id long, start long, stop long, a_ids array<int>, b_ids array<int>, pairs array<struct<a: int, b: int>>")
