"""Subword tokens with their places in the text, by a byte-level BPE or a piece model from a file.

The file is read once, on the driver; tasks get its content. Texts go to the tokenizers' own code in
batches, each distinct text of a batch once. Places come from the bytes that tokens stand for, in the
same way for either kind: a token that holds part of a character counts as holding all of it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.text import collapse_spaces

#: A character that no vocabulary joins with others: put before a text, it keeps a piece model from adding a space there.
GUARD = "龘"
#: Characters of a batch of texts, but for a single longer one.
_CHARS = 1 << 19
_TOKENS = "tokens array<struct<piece:string,id:int,start:int,end:int>>, sizes array<int>"


def _byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level entry stands for: printable Latin-1 characters stand for themselves, the others in order for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_level(content: str) -> tuple[Callable, list[str], list[bytes]]:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core, not all of them
    model, signs = Tokenizer.from_str(content), _byte_signs()
    model.encode_special_tokens = True
    known = json.loads(content)
    entries = known["model"]["vocab"] | {t["content"]: t["id"] for t in known["added_tokens"]}
    names = [""] * (max(entries.values()) + 1)
    for text, i in entries.items():
        names[i] = text
    held = [bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode() for t in names]

    def encode(texts: list[str], prefix: list[bool]) -> list[tuple[list[int], int]]:
        put = [p and not t.startswith(" ") for t, p in zip(texts, prefix, strict=True)]
        found = model.encode_batch([" " + t if p else t for t, p in zip(texts, put, strict=True)], add_special_tokens=False)
        return [(e.ids, int(p)) for e, p in zip(found, put, strict=True)]

    return encode, names, held


def _pieces(content: bytes) -> tuple[Callable, list[str], list[bytes]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    held = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    guard = model.encode(GUARD)

    def encode(texts: list[str], prefix: list[bool]) -> list[tuple[list[int], int]]:
        found = model.encode([t if p else GUARD + t for t, p in zip(texts, prefix, strict=True)], num_threads=1)
        return [(ids if p else ids[len(guard) :], int(p)) for ids, p in zip(found, prefix, strict=True)]

    return encode, names, held


def _placed(texts: list[str], found: list[tuple[list[int], int]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of ``texts``, one text behind the other: ids, starts and ends in characters of their text; how many tokens a text has; how many tokens end in each word; how many words a text has.

    ``found``: the ids of each text, which also hold that many bytes in front of it; ``lengths``: bytes of each token.
    """
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    lead = (data & 0xC0) != 0x80
    chars = np.array([len(t) for t in texts], np.int64)
    char_from = np.cumsum(chars) - chars
    # a byte for each character's first one; a text's bytes end where its characters do
    firsts = np.append(np.flatnonzero(lead), len(data))
    byte_from, byte_to = firsts[char_from], firsts[char_from + chars]
    char = np.append(np.cumsum(lead) - 1, len(firsts) - 1)
    n = np.array([len(ids) for ids, _ in found], np.int64)
    ids = np.concatenate([np.asarray(ids, np.int64) for ids, _ in found]) if n.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), n)
    upto = np.cumsum(lengths[ids])
    base = np.concatenate([[0], upto])[np.cumsum(n) - n] + np.array([b for _, b in found], np.int64)
    size = byte_to - byte_from
    ends = upto - base[row]
    starts = np.clip(ends - lengths[ids], 0, size[row])
    ends = np.clip(ends, 0, size[row])
    low = byte_from[row]
    place = lambda at: np.where(at < size[row], char[np.minimum(low + at, len(data))] - char_from[row], chars[row])
    last = np.where(ends > starts, char[np.maximum(low + ends - 1, 0)] - char_from[row] + 1, place(ends))
    breaks = np.flatnonzero(data == 32)
    spaces = np.searchsorted(breaks, byte_to) - np.searchsorted(breaks, byte_from)
    words = np.where(chars > 0, spaces + 1, 0)
    word_from = np.cumsum(words) - words
    word = np.searchsorted(breaks, low + np.maximum(ends - 1, 0), side="right") - np.searchsorted(breaks, byte_from)[row] + word_from[row]
    return ids, place(starts), last, n, np.bincount(word, minlength=int(words.sum())), words


def subwords(docs: DataFrame, model: str, *, prefix: Column | bool = True) -> DataFrame:
    """``docs`` (text, ...) with text in one-space form, tokens (piece, id, start, end by characters of that text) and sizes, the number of tokens that end in each of its words.

    ``model`` is a file of a byte-level BPE in JSON, or of a piece model. ``prefix``: whether a text
    counts as standing behind a space, as one that begins with white space does in any case; that
    space belongs to the first token and has no place. Null and empty texts have no tokens. Other
    columns stay; they must not be called tokens or sizes.
    """
    kind = _byte_level if model.endswith(".json") else _pieces
    with open(model, encoding="utf-8" if model.endswith(".json") else None, mode="r" if model.endswith(".json") else "rb") as f:
        content = f.read()
    flag = (F.lit(prefix) if isinstance(prefix, bool) else prefix) | F.col("text").startswith(" ")
    rows = docs.withColumn("text", collapse_spaces(F.coalesce("text", F.lit("")))).withColumn("__prefix", F.coalesce(flag, F.lit(True)))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, names, held = kind(content)
        names, lengths = pa.array(names, pa.string()), np.array([len(h) for h in held], np.int64)
        for batch in batches:
            size = np.cumsum(batch.column("text").to_pandas().str.len().to_numpy())
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _CHARS, side="right")))
                part = batch.slice(at, stop - at)
                at = stop
                keys = list(zip(part.column("text").to_pylist(), part.column("__prefix").to_pylist(), strict=True))
                distinct = [k for k in dict.fromkeys(keys) if k[0]]
                found = encode([t for t, _ in distinct], [p for _, p in distinct]) if distinct else []
                ids, starts, ends, n, ended, words = _placed([t for t, _ in distinct], found, lengths)
                place = {k: i for i, k in enumerate(distinct)}
                rows_ = pa.array([place.get(k, len(distinct)) for k in keys])  # texts without tokens: the empty list behind the others
                lists = lambda n: pa.array(np.concatenate([[0], np.cumsum(n), [n.sum()]]), pa.int32())
                structs = pa.StructArray.from_arrays([names.take(pa.array(ids)), *[pa.array(x, pa.int32()) for x in (ids, starts, ends)]], names=["piece", "id", "start", "end"])
                tokens = pa.ListArray.from_arrays(lists(n), structs).take(rows_)
                sizes = pa.ListArray.from_arrays(lists(words), pa.array(ended, pa.int32())).take(rows_)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], tokens, sizes], [*columns, "tokens", "sizes"])

    kept = ", ".join(f"`{c}` {t}" for c, t in rows.select(*[F.col(f"`{c}`") for c in columns]).dtypes)
    return rows.mapInArrow(run, f"{kept}, {_TOKENS}")


def segment_subwords(rows: DataFrame, model: str, *, prefix: bool = True) -> DataFrame:
    """``subwords`` of the segments that texts are cut into, from rows (page, i, text): a segment stands behind a space if the one before ends with one or is empty, the first one by ``prefix``."""
    before = F.lag("text").over(Window.partitionBy("page").orderBy("i"))
    flag = F.when(F.row_number().over(Window.partitionBy("page").orderBy("i")) == 1, F.lit(prefix)).otherwise(before.endswith(" ") | (F.coalesce(before, F.lit("")) == ""))
    flagged = rows.withColumn("__flag", flag)
    return subwords(flagged, model, prefix=F.col("__flag")).drop("__flag")
