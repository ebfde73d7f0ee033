"""Operator 7: token counts by heap-and-linked-list byte-pair merging.

The count of a word is its initial symbols minus its merges; no ids are made.
Each word is counted once per worker and kept in a bounded memo.

Cases: a null text counts as empty (0 bytes, 0 tokens); a null doc_id stays
null; repeated rows are counted each; other columns are left out. One scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm import bpe

#: Fixed value: the split pattern of byte-level BPE.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PAIR = regex.compile(r"\s\s").search
CHUNKS = regex.compile(r"\s*\S+|\s+").findall

_COUNTERS: dict[str, Counter] = {}


class Counter:
    def __init__(self, path: str) -> None:
        self.vocabulary = bpe.Vocabulary(path)
        self.find = regex.compile(BYTE_PATTERN).findall
        self.words = bpe.Memo(self._word, limit=3 * bpe.CACHE_WORDS)
        self.chunks = bpe.Memo(self._chunk)
        self.spaced = bpe.Memo(lambda chunk: self._chunk(f" {chunk}"), limit=2 * bpe.CACHE_WORDS)

    def _word(self, word: str) -> int:
        ids = self.vocabulary.symbols(word)
        return len(ids) - bpe.count_merges(ids, self.vocabulary)

    def _chunk(self, chunk: str) -> int:
        return sum(map(self.words.__getitem__, self.find(chunk)))

    def _piece(self, text: str) -> int:
        """Every word begins where white space follows other text, so chunks cut there are counted apart and remembered."""
        if PAIR(text):
            return sum(map(self.chunks.__getitem__, CHUNKS(text)))
        first, *rest = text.split(" ")  # every space follows other text here
        return self.chunks[first] + sum(map(self.spaced.__getitem__, rest))

    def count(self, text: str) -> int:
        """Special strings count as one token each."""
        pieces = self.vocabulary.segments(text)
        return len(pieces) // 2 + sum(map(self._piece, pieces[::2]))


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            counts = pa.array([count(scalar.as_py()) for scalar in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], names=[id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text.alias("_text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"{id_col} long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
