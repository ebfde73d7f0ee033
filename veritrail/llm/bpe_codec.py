"""Operator 4: BPE encoding and decoding with a contiguous rank array.

Words are cut by the tokenizer's own pattern after NFC and lower-casing; each
is merged once per worker and kept in a bounded memo. A word of over
``bpe.SHORT`` symbols is merged with a heap instead, with the same result, as
scanning it would take time with the square of its length.

Cases: a null text counts as empty (no ids, empty decoded text); a null doc_id
stays null; repeated rows are encoded each; other columns are left out.
Runs as one scan, without a shuffle; memory per task is one Arrow batch and the memo.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm import bpe

#: Fixed value: the split pattern of the word-end tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Python's split() takes these for white space, the pattern does not.
ODD_SPACE = regex.compile(r"[\x1c-\x1f]").search

_CODECS: dict[str, Codec] = {}


class Codec:
    """encode and decode for a vocabulary whose words carry an end mark."""

    def __init__(self, path: str) -> None:
        self.vocabulary = bpe.Vocabulary(path)
        self.find = regex.compile(WORD_PATTERN).findall
        self.words = bpe.Memo(self._word, limit=bpe.CACHE_WORDS)
        self.chunks = bpe.Memo(self._chunk, limit=3 * bpe.CACHE_WORDS // 4)
        self.numbers = [str(i) for i in range(len(self.vocabulary.names))]

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.vocabulary.symbols(word)
        merge = bpe.merge_short if len(ids) <= bpe.SHORT else bpe.merge_long
        return tuple(merge(ids, self.vocabulary))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.words.__getitem__, self.find(chunk))))

    def encode(self, text: str) -> list[int]:
        """No word holds white space, so text is cut there first and what lies between is remembered."""
        ids: list[int] = []
        for k, segment in enumerate(self.vocabulary.segments(text)):
            if k % 2:
                ids.append(self.vocabulary.special[segment])
            else:
                segment = bpe.lower_each(bpe.composed(segment))
                chunks = self.find(segment) if ODD_SPACE(segment) else segment.split()
                ids.extend(chain.from_iterable(map(self.chunks.__getitem__, chunks)))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens' own strings, word ends included, with one space between: the file names no decoder."""
        return " ".join(map(self.vocabulary.names.__getitem__, ids))


def codec(path: str) -> Codec:
    """One codec per worker and path."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _lists(flat: array, counts: list[int]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, ids ARRAY<INT> for each row of ``docs``; [] for a null or empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            flat, counts = array("i"), []
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                counts.append(len(ids))
                flat.extend(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(flat, counts)], names=[id_col, "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(run, f"{id_col} long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Returns id_col, text for each row of (id_col, ids); null ids give a null text, an id outside the vocabulary an empty token."""

    def text_of(coder: Codec, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        size = len(coder.vocabulary.names)
        return coder.decode(ids) if all(i is not None and 0 <= i < size for i in ids) else " ".join(coder.vocabulary.names[i] if i is not None and 0 <= i < size else "" for i in ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = pa.array([text_of(coder, ids) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "text"])

    return encoded.select(F.col(id_col).cast("long").alias(id_col), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"{id_col} long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes, decodes from the ids and digests both in one pass: id_col, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        numbers = coder.numbers.__getitem__
        for batch in batches:
            flat, counts, digests, decoded = array("i"), [], [], []
            for scalar in batch.column(1):
                ids = coder.encode(scalar.as_py() or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(" ".join(map(numbers, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids).encode("utf-8")).hexdigest())
                if keep_ids:
                    flat.extend(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([_lists(flat, counts)] if keep_ids else [])], names=names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
