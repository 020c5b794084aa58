"""Edit-aware token counts (operator 10): a segment tree over each document's pre-tokens.

Leaves hold the length and the token count of a pre-token, inner nodes the sums below them. After
edits only the pre-tokens that they touch are encoded again, from a little before the first one to
the first boundary, old and new alike, behind the last: the pattern looks at nothing before the
place where it stands, so that from there on all pre-tokens are as they were. The new counts go into
the first leaf of the stretch, the others become empty, and the sums above are updated.
"""

from __future__ import annotations

import base64
import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.common import text_slices, wanted

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHED = 250_000
Edit = tuple[int, int, str]


class Stretch(NamedTuple):
    """Leaves ``first`` to ``last``, and the pre-tokens that are there now."""

    first: int
    last: int
    pieces: list[str]


class Tree:
    """Sums of two values over leaves: rows 0 (code points) and 1 (tokens) of ``sums``, node 1 the root, leaf i at ``width`` + i."""

    def __init__(self, sums: np.ndarray):
        self.sums, self.width = sums, sums.shape[1] // 2

    @classmethod
    def build(cls, lengths: np.ndarray, tokens: np.ndarray) -> Tree:
        width = 1 << max(0, (len(lengths) - 1).bit_length())
        sums = np.zeros((2, 2 * width), np.int32)
        sums[0, width : width + len(lengths)], sums[1, width : width + len(tokens)] = lengths, tokens
        while width > 1:
            sums[:, width // 2 : width] = sums[:, width : 2 * width : 2] + sums[:, width + 1 : 2 * width : 2]
            width //= 2
        return cls(sums)

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def starts(self) -> np.ndarray:
        """Where each leaf starts, and the text's length."""
        return np.concatenate([[0], np.cumsum(self.sums[0, self.width :], dtype=np.int64)])

    def fill(self, stretches: list[Stretch], tokens: list[int]) -> None:
        """Each stretch of leaves becomes one at its first; then the sums above all of them, level by level."""
        low, high = np.array([[s.first, s.last] for s in stretches]).T + self.width
        sizes = high - low + 1
        touched = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        self.sums[:, touched] = 0
        self.sums[0, low], self.sums[1, low] = [sum(map(len, s.pieces)) for s in stretches], tokens
        while touched[0] > 1:
            touched = touched // 2
            touched = touched[np.concatenate([[True], np.diff(touched) > 0])]
            self.sums[:, touched] = self.sums[:, 2 * touched] + self.sums[:, 2 * touched + 1]


def edited(text: str, edits: list[Edit]) -> str:
    """``text`` with its spans replaced; edits are in order and don't overlap."""
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def touched(tree: Tree, text: str, edits: list[Edit], pattern) -> tuple[str, list[Stretch]]:
    """The edited text, and the stretches of pre-tokens that the edits touch, cut anew."""
    if not edits:
        return text, []
    new, starts = edited(text, edits), tree.starts()
    places = starts.tolist()
    cuts = starts[np.concatenate([[True], np.diff(starts) > 0])].tolist()  # empty leaves once
    out: list[Stretch] = []
    i = shift = done = 0  # done: the boundary up to which all is cut, in the old text
    while i < len(edits):
        # one pre-token before the one that the edit touches, as 're looks two ahead, and white space before that
        k = max(0, bisect_right(cuts, max(0, edits[i][0] - 1)) - 2)
        while k and text[cuts[k - 1] : cuts[k]].isspace():
            k -= 1
        begin = max(cuts[k], done)
        place, change, j, pieces = begin + shift, 0, i, []
        while True:
            while j < len(edits) and edits[j][0] + shift + change <= place:
                change += len(edits[j][2]) - (edits[j][1] - edits[j][0])
                j += 1
            old = place - shift - change
            if place == len(new) or j > i and old > begin and old >= edits[j - 1][1] and cuts[bisect_left(cuts, old)] == old:
                break
            pieces.append(pattern.match(new, place)[0])
            place += len(pieces[-1])
        first = min(bisect_right(places, begin) - 1, tree.width - 1)
        out.append(Stretch(first, max(first, bisect_left(places, old) - 1), pieces))
        i, shift, done = j, shift + change, old
    return new, out


def apply_all(trees: list[Tree], texts: list[str], edits: list[list[Edit]], pattern, count: Callable[[list[str]], list[int]]) -> tuple[list[str], list[int]]:
    """The edited texts, and the code points that were encoded again; ``trees`` follow the edits. All texts' pre-tokens are counted at once."""
    done = [touched(*x, pattern) for x in zip(trees, texts, edits, strict=True)]
    counts = iter(count([p for _, stretches in done for s in stretches for p in s.pieces]))
    again = []
    for tree, (_, stretches) in zip(trees, done, strict=True):
        if stretches:
            tree.fill(stretches, [sum(itertools.islice(counts, len(s.pieces))) for s in stretches])
        again.append(sum(len(p) for s in stretches for p in s.pieces))
    return [new for new, _ in done], again


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    """The merges' ranks, as many as the vocabulary has; read on the driver."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Counter:
    """Pre-tokens of texts and their token counts; remembers those it has met, up to a number."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex
        import tiktoken

        self.pattern = regex.compile(PATTERN)
        self.coding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        (self.line_break,) = self.coding.encode_ordinary("\n")

    def count(self, pieces: list[str]) -> list[int]:
        if len(self.known) > _CACHED:
            self.known.clear()
        new = set(pieces).difference(self.known)
        for blank in [p for p in new if p.isspace()]:
            self.known[blank] = len(self.coding.encode_ordinary(blank))
            new.remove(blank)
        if new:
            # in one call: a line break is a pre-token of its own between others, and one token
            ids = np.array(self.coding.encode_ordinary("\n".join(new) + "\n"))
            ends = np.flatnonzero(ids == self.line_break)
            self.known.update(zip(new, (np.diff(ends, prepend=-1) - 1).tolist(), strict=True))
        return list(map(self.known.__getitem__, pieces))

    def trees(self, texts: list[str]) -> list[Tree]:
        cut = [self.pattern.findall(t) for t in texts]
        pieces = list(itertools.chain.from_iterable(cut))
        lengths = np.fromiter(map(len, pieces), np.int32, len(pieces))
        tokens = np.array(self.count(pieces), np.int32)
        ends = np.cumsum([len(c) for c in cut])
        return [Tree.build(lengths[e - len(c) : e], tokens[e - len(c) : e]) for c, e in zip(cut, ends.tolist(), strict=True)]


def _shared(spark: SparkSession, path: str) -> Callable[[], Counter]:
    """Makes a Counter in a task; the ranks are broadcast, a table of the vocabulary's fixed size."""
    sent = spark.sparkContext.broadcast(load_ranks(path))
    return lambda: Counter(sent.value)


def build_trees(docs: DataFrame, *, ranks: str = RANKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns ``keep``, tree (int32 sums, as bytes) and n_tokens for each row of ``docs`` (doc_id, text).

    A null text counts as empty: no tokens. Nulls and repeats of doc_id stay; other columns are
    ignored; an empty table gives no rows. One narrow pass.
    """
    types = dict(docs.dtypes)
    docs = wanted(docs, {"doc_id": "long", "text": "string"} | {c: types[c] for c in keep})
    columns, make = docs.columns, _shared(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make()
        for part in text_slices(batches):
            trees = counter.trees(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array([t.sums.tobytes() for t in trees], pa.binary()), pa.array([t.total for t in trees], pa.int64())], [*columns, "tree", "n_tokens"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", tree binary, n_tokens long")


def _in_order(text: str, edits: list[Edit]) -> list[Edit]:
    edits = sorted((min(a, len(text)), min(b, len(text)), new) for a, b, new in edits)
    if any(a[1] > b[0] for a, b in itertools.pairwise(edits)):
        raise ValueError("edits overlap")
    return edits


def update_trees(trees: DataFrame, *, ranks: str = RANKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``trees`` (doc_id, text, tree, edits: array of struct<start, end, text> over code points) after its edits.

    Gives doc_id, text, tree, n_tokens, n_edits and n_again, the code points encoded again, and the columns ``keep``. Edits
    are taken in order of start; null edits are none, a null replacement is empty. Ends beyond the
    text are cut to it; edits that overlap an earlier one are not defined and raise an error.
    """
    make, types = _shared(trees.sparkSession, ranks), dict(trees.dtypes)
    trees = wanted(trees, {"doc_id": "long", "text": "string", "tree": "binary", "edits": "array<struct<start:bigint,end:bigint,text:string>>"} | {c: types[c] for c in keep})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make()
        for part in text_slices(batches):
            texts, raw, given = (part.column(c).to_pylist() for c in ("text", "tree", "edits"))
            trees = [Tree(np.frombuffer(r, np.int32).reshape(2, -1).copy()) for r in raw]
            edits = [_in_order(t, [(e["start"], e["end"], e["text"] or "") for e in g or () if e is not None]) for t, g in zip(texts, given, strict=True)]
            new, again = apply_all(trees, texts, edits, counter.pattern, counter.count)
            columns = [pa.array(new, pa.string()), pa.array([t.sums.tobytes() for t in trees], pa.binary()), *[pa.array(c, pa.int64()) for c in ([t.total for t in trees], list(map(len, edits)), again)]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns] + [part.column(c) for c in keep], ["doc_id", "text", "tree", "n_tokens", "n_edits", "n_again", *keep])

    return trees.mapInArrow(run, "doc_id long, text string, tree binary, n_tokens long, n_edits long, n_again long" + "".join(f", `{c}` {types[c]}" for c in keep))


_CLEANED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|!!++")


def cleaning_edits(text: str) -> list[Edit]:
    """Edits that a cleaning step would make: a mark before the text, each e-mail address as <email>, and one ! of a run."""
    edits = [(0, 0, "<doc>")]
    if "@" in text or "!!" in text:
        edits += [(*m.span(), "!" if m[0][0] == "!" else "<email>") for m in _CLEANED.finditer(text)]
    return edits


def edit_counts(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = cleaning_edits, *, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_before, n_tokens (after), n_edits, n_chars (after) and n_again of each row of ``docs`` (doc_id, text) for the edits that ``edits_of`` makes of its text.

    Trees are built and updated in one pass, for edits that follow from the text; build_trees and
    update_trees keep them between passes. Nulls and repeats as there.
    """
    make = _shared(docs.sparkSession, ranks)
    docs = wanted(docs, {"doc_id": "long", "text": "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make()
        for part in text_slices(batches):
            texts = part.column("text").to_pylist()
            trees = counter.trees(texts)
            before, edits = [t.total for t in trees], [_in_order(t, edits_of(t)) for t in texts]
            new, again = apply_all(trees, texts, edits, counter.pattern, counter.count)
            columns = [before, [t.total for t in trees], list(map(len, edits)), list(map(len, new)), again]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "n_before", "n_tokens", "n_edits", "n_chars", "n_again"])

    return docs.mapInArrow(run, "doc_id long, n_before long, n_tokens long, n_edits long, n_chars long, n_again long")
