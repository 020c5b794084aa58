"""SentencePiece encoding and decoding (operator 3) by batched numpy Viterbi.

A text with its dummy prefix is cut before each run of spaces, which no piece crosses. The distinct
words of a batch are encoded once: words of equal length advance together, all their substrings'
hashes are probed in the sorted keys of the pieces, and at each place the best way to end there is
a maximum over the pieces' lengths, kept as a backpointer. Characters that no piece holds become
byte pieces.

The pieces at hand are of a model whose own encoding merges pairs: its scores are merge ranks, which
are taken as unigram scores here. The result is the best-scoring segmentation by them, not what that
model's own encoder gives; ids for training with that model must come from its merges. A unigram
model's file, given as ``model``, gives its own encoding.

A word is encoded whole: its length times the longest piece's length (about 17) cells of 12 bytes
are held, and each of its characters is one step, so that a word of 200,000 characters takes some
seconds and 40 MB. Nothing is cut.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spanforge.llm.common import text_slices, wanted
from spanforge.llm.words import _power, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_CACHED, _CELLS = 150_000, 100_000


@dataclass
class PieceTable:
    """What encoding and decoding need of a model; its size is the vocabulary's."""

    keys: np.ndarray  # sorted hashes of the pieces' code points
    scores: np.ndarray
    ids: np.ndarray
    longest: int
    unknown: float
    bytes_: np.ndarray  # ids of the 256 byte pieces
    text: list[bytes]  # what each id decodes to
    crosses: bool  # whether a piece has a space after another character
    sieve: np.ndarray


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _prefix_sums(codes: np.ndarray) -> np.ndarray:
    up, _ = _power(codes.shape[1] + 1)
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[: codes.shape[1]], axis=1, out=sums[:, 1:])
    return sums


def _keys(sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all substrings of ``length`` code points."""
    _, down = _power(sums.shape[1])
    return mix((sums[:, length:] - sums[:, :-length]) * down[: sums.shape[1] - length] + np.full(1, length, np.uint64))


def load(path: str = MODEL) -> PieceTable:
    """The table of a model file with byte pieces; read on the driver, once."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    byte_of = {i: int(names[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
    if len(byte_of) != 256:
        raise ValueError("the model has no byte pieces")
    keys = np.array([_keys(_prefix_sums(_codes([names[i]], len(names[i]))), len(names[i]))[0, 0] for i in normal], np.uint64)
    scores = np.array([sp.get_score(i) for i in normal])
    by = np.argsort(keys)
    if (np.diff(keys[by].astype(np.float64)) == 0).any() and len(np.unique(keys)) < len(keys):
        raise ValueError("two pieces have one key")
    text = [bytes([byte_of[i]]) if i in byte_of else names[i].replace(SPACE, " ").encode() if not sp.is_control(i) and not sp.is_unknown(i) else b"" for i in range(n)]
    bytes_ = np.zeros(256, np.int32)
    for i, b in byte_of.items():
        bytes_[b] = i
    sieve = np.zeros(1 << 20, bool)
    sieve[keys >> np.uint64(44)] = True
    return PieceTable(keys[by], scores[by], np.array(normal, np.int32)[by], max(len(names[i]) for i in normal), float(scores.min()) - 10, bytes_, text, any(SPACE in names[i].lstrip(SPACE) for i in normal), sieve)


def viterbi(table: PieceTable, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The best pieces' ids for words of one length, one word after another, and how many each has; of equally good ways the one whose last piece is longer."""
    length, n = len(words[0]), len(words)
    codes = _codes(words, length)
    sums = _prefix_sums(codes)
    most = min(length, table.longest)
    score = np.full((most + 1, n, length), -np.inf)  # by piece length and start
    piece = np.full((most + 1, n, length), -1, np.int32)
    for size in range(1, most + 1):
        keys = _keys(sums, size)
        row, col = np.nonzero(table.sieve[keys >> np.uint64(44)])
        own = keys[row, col]
        at = np.minimum(np.searchsorted(table.keys, own), len(table.keys) - 1)
        hit = table.keys[at] == own
        score[size, row[hit], col[hit]] = table.scores[at[hit]]
        piece[size, row[hit], col[hit]] = table.ids[at[hit]]
    score[1][piece[1] < 0] = table.unknown
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, length + 1), np.int32)
    everyone = np.arange(n)
    for end in range(1, length + 1):
        sizes = np.arange(min(end, most), 0, -1)
        ways = best[:, end - sizes] + score[sizes, :, end - sizes].T
        pick = ways.argmax(axis=1)
        best[:, end] = ways[everyone, pick]
        back[:, end] = sizes[pick]
    # back along the pointers, all words together; ids are filled in from the right
    ids = np.full((n, length), -1, np.int32)
    place, column, left = np.full(n, length), length, everyone
    while len(left):
        column -= 1
        size = back[left, place[left]]
        place[left] -= size
        found = piece[size, left, place[left]]
        ids[left, column] = np.where(found >= 0, found, -2 - place[left])  # what no piece holds: its place
        left = left[place[left] > 0]
    row, col = np.nonzero(ids != -1)
    flat, count = ids[row, col], np.bincount(row, minlength=n)
    missing = np.flatnonzero(flat < 0)
    if len(missing):
        coded = [table.bytes_[list(words[row[i]][-2 - flat[i]].encode())] for i in missing.tolist()]
        sizes = np.ones(len(flat), np.int64)
        sizes[missing] = [len(c) for c in coded]
        count = np.bincount(row, sizes, minlength=n).astype(np.int64)
        flat = np.repeat(flat, sizes)
        flat[np.repeat(np.isin(np.arange(len(sizes)), missing), sizes)] = np.concatenate(coded)
    return flat, count


class Encoder:
    """Encodes texts, and keeps the words it has met, up to a number."""

    def __init__(self, table: PieceTable):
        self.table = table
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*" if not table.crosses else "(?s).+")
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        parts, counts = [self.flat], []
        for length, own in by.items():
            step = max(1, _CELLS // length)
            for i in range(0, len(own), step):
                flat, count = viterbi(self.table, own[i : i + step])
                parts.append(flat)
                counts.append(count)
                self.place.update(zip(own[i : i + step], itertools.count(len(self.place))))
        self.flat = np.concatenate(parts)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(counts))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the texts' offsets in them."""
        cut = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = list(itertools.chain.from_iterable(cut))
        if len(self.place) > _CACHED:
            self._forget()
        if new := set(words).difference(self.place):
            self._learn(sorted(new))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        size = self.offsets[at + 1] - self.offsets[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.offsets[at] - ends[:-1], size)]
        return ids, ends[np.concatenate([[0], np.cumsum([len(w) for w in cut])]).astype(np.int64)].astype(np.int64)


def encode(docs: DataFrame, *, model: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` of ``docs``, token_ids and n_tokens for each row.

    Null and empty texts have no tokens. Null and repeated doc_ids stay as they are; other columns
    are ignored; an empty table gives no rows. The model's table goes to the tasks, its file is
    read on the driver only. Nothing is shuffled.
    """
    table = load(model)
    types = dict(docs.dtypes)
    docs = wanted(docs, {"doc_id": "long", "text": "string"} | {c: types[c] for c in keep})
    columns = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table)
        for part in text_slices(batches):
            ids, offsets = encoder.encode(part.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], lists, pa.array(np.diff(offsets))], [*columns, "token_ids", "n_tokens"])

    kept = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    out = docs.mapInArrow(run, f"{kept}, token_ids array<int>, n_tokens long")
    return out if "text" in keep else out.drop("text")


def _texts(pieces: list[bytes], ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """What runs of ids decode to; the space that the dummy prefix has left goes."""
    parts = list(map(pieces.__getitem__, ids.tolist()))
    return [b"".join(parts[a:b]).decode("utf-8", "replace").removeprefix(" ") for a, b in itertools.pairwise(offsets.tolist())]


def decode(tokens: DataFrame, *, model: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` and decoded for each row of ``tokens`` (doc_id, token_ids); null ids decode to an empty text, bytes that aren't UTF-8 to U+FFFD."""
    pieces = load(model).text
    types = dict(tokens.dtypes)
    tokens = wanted(tokens, {"doc_id": "long", "token_ids": "array<int>"} | {c: types[c] for c in keep})
    columns = [c for c in tokens.columns if c != "token_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lists = part.column("token_ids")
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = _texts(pieces, lists.flatten().to_numpy(zero_copy_only=False), offsets)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(texts, pa.string())], [*columns, "decoded"])

    kept = ", ".join(f"`{c}` {t}" for c, t in tokens.drop("token_ids").dtypes)
    return tokens.mapInArrow(run, f"{kept}, decoded string")


def round_trip(docs: DataFrame, *, model: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, token_ids, n_tokens and same (whether decoding gives the text again) for each row of ``docs``, in one pass.

    A null text counts as empty; one with U+2581 comes back with spaces, so that same is false.
    """
    table, types = load(model), dict(docs.dtypes)
    docs = wanted(docs, {"doc_id": "long", "text": "string"} | {c: types[c] for c in keep})
    columns = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table)
        for part in text_slices(batches):
            texts = part.column("text").to_pylist()
            ids, offsets = encoder.encode(texts)
            same = [a == b for a, b in zip(texts, _texts(table.text, ids, offsets), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], lists, pa.array(np.diff(offsets)), pa.array(same, pa.bool_())], [*columns, "token_ids", "n_tokens", "same"])

    kept = ", ".join(f"`{c}` {t}" for c, t in docs.drop("text").dtypes)
    return docs.mapInArrow(run, f"{kept}, token_ids array<int>, n_tokens long, same boolean")
