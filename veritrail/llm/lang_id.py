"""Operator 5: language identification by averaged hashed subword embeddings.

A text is reduced to lower-case letters with single spaces between words; every
2, 3 and 4 bytes in a row (spaces included, so word ends count) are hashed into
``BUCKETS`` rows of an embedding, the embeddings of all subwords of the whole
text are averaged, and a linear softmax names the language. Embedding and
softmax are trained together by stochastic gradient descent in numpy.

Calibration: a fifth of the training sample is kept out of the descent. There a
temperature is fitted to the logits by likelihood, and the rejection threshold
is the largest score, at most ``HIGHEST_CUT``, that rejects at most
``LOST`` of the documents it names rightly. A document scored below it is rejected.

Every value of lang is learned. Training reads a bounded sample of labelled
documents of each: its share of ``SAMPLE``, but ``LEAST_EACH`` at least, so with
very many languages the sample grows with their number alone. Those with the
smallest hashes of doc_id and text are taken, each once, and enter the descent in
the order of these, so any partitioning gives the same weights. They are hashed on
the executors and come to the driver as counts of at most BUCKETS entries each; a
count of documents per language is all that is gathered besides.

Cases: a null text, or one without a letter, is ``und`` with score 1 and
rejected; a null lang is never learned, nor is a row with a null doc_id, which
is never held out; with no labelled document at all every text is ``und``
with score 0; one language alone is always named; repeated rows are each
predicted; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 13
DIM = 16
SAMPLE = 1600
LEAST_EACH = 20
EPOCHS = 8
BATCH = 32
RATE = 20.0
LOST = 0.001
HIGHEST_CUT = 0.5
UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}").search
#: Odd multipliers that spread the bytes of a subword.
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: A text is hashed in pieces of so many bytes, so a long one takes bounded memory; all pieces count.
PIECE = 1 << 20


def subwords(text: str | None) -> np.ndarray | None:
    """How often each bucket occurs in the whole text; None without a letter."""
    if not text or not _LETTER(text):
        return None
    data = np.frombuffer(f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode(), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE + 3].astype(np.uint32)
        hashed = piece * np.uint32(MIX[0])
        for n in (1, 2, 3):
            hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) + piece[n:] * np.uint32(MIX[n])
            own = hashed[: max(0, min(PIECE, len(data) - at - n))]
            if len(own):
                counts += np.bincount((own * np.uint32(MIX[0])) >> np.uint32(32 - 13), minlength=BUCKETS)
    return counts


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # embedding times softmax weights: bucket by language
    bias: np.ndarray
    temperature: float = 1.0
    cut: float = 0.0

    def scores(self, counts: np.ndarray) -> np.ndarray:
        logits = (counts @ self.weights / max(1, counts.sum()) + self.bias) / self.temperature
        odds = np.exp(logits - logits.max())
        return odds / odds.sum()


def _softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """counts: buckets and how often each occurs, by document; labels: index into ``languages``. Every fifth document calibrates, the others train."""

    def shares(rows: np.ndarray) -> np.ndarray:
        """Documents by buckets, for a batch alone."""
        made = np.zeros((len(rows), BUCKETS), np.float32)
        for k, row in enumerate(rows.tolist()):
            buckets, often = counts[row]
            made[k, buckets] = often / max(1, often.sum())
        return made

    calibrate = np.arange(len(labels)) % 5 == 4
    if len(labels) < 10:
        calibrate[:] = False
    train, rng = np.flatnonzero(~calibrate), np.random.default_rng(seed)
    embed = rng.normal(0, 0.5, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, step = max(1, EPOCHS * -(-len(train) // BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            x = shares(rows)
            hidden = x @ embed
            error = _softmax(hidden @ out + bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            back = error @ out.T
            out -= rate * (hidden.T @ error)
            bias -= 0.05 * rate * error.sum(axis=0)
            embed -= 4 * rate * (x.T @ back)
            step += 1
    model = Model(languages, embed @ out, bias)
    held = np.flatnonzero(calibrate)
    if len(held):
        logits = np.concatenate([shares(held[at : at + BATCH]) @ model.weights + bias for at in range(0, len(held), BATCH)])
        truth = labels[held]
        fits = [(-np.log(_softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean(), t) for t in np.geomspace(0.05, 8, 41)]
        model.temperature = float(min(fits)[1])
        odds = _softmax(logits / model.temperature)
        right = np.sort(odds.max(axis=1)[odds.argmax(axis=1) == truth])
        if len(right):
            model.cut = float(min(HIGHEST_CUT, right[int(LOST * len(right))]))
    return model


def _fold(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)), F.lit(0))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from the rows that are not held out and have a language and an id."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (_fold(id_col) != 2)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = known.groupBy("lang").count()
    languages = sorted(r["lang"] for r in sizes.collect())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    each = max(sample // len(languages), LEAST_EACH)
    place = F.xxhash64(F.col("id").cast("string"), F.lit("lang_id"))
    # Places are even over 64 bits; half as many more than needed are looked at, and a few besides.
    few = (place / F.lit(2.0**63) + 1) / 2 < F.lit(1.5 * each + 20) / F.col("count")
    # One row per class of the model, which the driver holds anyway.
    near = known.join(F.broadcast(sizes), "lang").where(few).withColumn("place", place).withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("place", "h")
    near = near.dropDuplicates(["lang", "place", "h"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(c, lang, rank) for c, lang, rank in zip(map(subwords, batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_pylist()) if c is not None]
            keep = [np.flatnonzero(c) for c, *_ in made]
            yield pa.RecordBatch.from_arrays([pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.int32()), pa.array([k.astype(np.int16) for k in keep], pa.list_(pa.int16())), pa.array([c[k].astype(np.int32) for (c, *_), k in zip(made, keep)], pa.list_(pa.int32()))], names=["lang", "rank", "buckets", "counts"])

    rows = near.select("text", "lang", "rank").mapInArrow(run, "lang string, rank int, buckets array<short>, counts array<int>").toArrow()
    known_as = {lang: k for k, lang in enumerate(languages)}
    labels = np.array([known_as[x] for x in rows["lang"].to_pylist()], np.int64)
    order = np.lexsort((rows["rank"].to_numpy(), labels)).tolist()  # the same order however rows arrive
    buckets, counts = rows["buckets"], rows["counts"]
    made = [(buckets[i].values.to_numpy().copy(), counts[i].values.to_numpy().astype(np.float32)) for i in order]
    del rows, buckets, counts
    return fit(made, labels[order], languages)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, text_hash, held_out, lang_pred, score, rejected for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in batch.column(3):
                counts = subwords(text.as_py())
                if counts is None or not model.languages:
                    langs.append(UNKNOWN)
                    scores.append(1.0 if counts is None else 0.0)
                    rejected.append(True)
                else:
                    odds = model.scores(counts)
                    best = int(odds.argmax())
                    langs.append(model.languages[best])
                    scores.append(float(odds[best]))
                    rejected.append(bool(odds[best] < model.cut))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[id_col, "text_hash", "held_out", "lang_pred", "score", "rejected"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.xxhash64(text).alias("text_hash"), (_fold(id_col) == 2).alias("held_out"), text.alias("_text"))
    return rows.mapInArrow(run, f"{id_col} long, text_hash long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns; one pass, no shuffle."""

    @F.pandas_udf("boolean")
    def accepted(texts):  # noqa: ANN001, ANN202
        def one(text: str | None) -> bool:
            counts = subwords(text)
            return counts is not None and bool(model.languages) and float(model.scores(counts).max()) >= model.cut

        return texts.map(one).astype(bool)

    return docs.where(accepted(F.col(text_col).cast("string")))
