"""Operator 11: secrets by base patterns and by character Markov models.

Base spans are assigned values (``assign``), access keys (``access``) and runs of
hexadecimal digits (``hex``). Beside them two Markov chains over characters, one
of random strings and one of ordinary identifiers, give every other word of
``LEAST`` or more ASCII letters, digits and ``+ / = _ -`` a log-likelihood ratio;
one that exceeds the threshold is an added span of kind ``random``, so a key is
found that stands without a name before it.

A word is judged in parts, between ``+ / = _ -`` and before a capital that
follows a small letter or digit, whatever the case: an identifier is made of few
long ordinary parts, a random string of many odd ones. Both chains have order
two, backed off to order one and to equal odds, so characters that no sample
holds say nothing either way. Words without a letter are numbers and not judged.
The chains are trained from labelled samples, a table of (sample STRING, secret
BOOLEAN). ``samples`` makes one from the documents: values of base spans are
secrets, other words of ``LEAST_SAMPLE`` characters or more are not. It keeps the
``SAMPLE`` distinct strings of each class with the smallest hashes, chosen in each
task and then among them, so copies of a text count once, and the choice doesn't
depend on the partitioning.
A quarter of the ordinary strings is held out: the threshold is the log of
``PRIOR_ODDS`` to one, and at least the ratio that the share ``FALSE_ALARMS`` of
them exceeds.

Cases: a null text counts as empty: no span, and the digest of an empty string;
a null doc_id is kept; repeated rows are searched each; other columns are left
out. Without samples of both classes nothing is added to the base spans. A word
that overlaps a base span, or stands next to a letter or digit of another
alphabet, is not judged. Patterns run in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ADDED = "random"
LEAST, LEAST_SAMPLE = 16, 4
SAMPLE = 8000
#: Ordinary words of a text for each secret that has no name before it.
PRIOR_ODDS = 1000.0
FALSE_ALARMS = 0.001
#: Weight of the shorter context against counts of the longer one.
BACK_OFF = 8.0

_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs are taken whole, so only their starts are tried.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_WORD = re.compile(rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{LEAST_SAMPLE},}}")

_LETTER = re.compile("[A-Za-z]").search
_PART = re.compile(r"[a-z0-9]+|[A-Z][A-Z0-9]*[a-z0-9]*|[^A-Za-z0-9+/=_-]+")
_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Symbol 0 is the edge of a part, the last one anything else.
SYMBOLS = len(_CHARACTERS) + 2
_SYMBOL_OF = np.full(256, SYMBOLS - 1, np.uint8)
_SYMBOL_OF[np.frombuffer(_CHARACTERS.encode(), np.uint8)] = np.arange(1, SYMBOLS - 1)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of each kind, in code points, ordered by start, then kind."""
    return [span for span, _ in _valued(text)]


def _valued(text: str) -> list[tuple[Span, str]]:
    """Base spans with the secret value each holds."""
    found: list[tuple[Span, str]] = []
    lower = text.lower()
    if any(key in lower for key in _KEYS):
        found += [(("assign", m.start(), m.end()), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(("access", m.start(), m.end()), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(("hex", m.start(), m.end()), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0][1], KINDS.index(x[0][0])))


def other_words(text: str, base: list[Span], least: int = LEAST) -> list[tuple[int, int]]:
    """Places of words of ``least`` or more characters that overlap no base span."""
    found, at, reach = [], 0, 0
    for m in _WORD.finditer(text):
        start, end = m.span()
        if end - start < least:
            continue
        while at < len(base) and base[at][1] < end:
            reach = max(reach, base[at][2])
            at += 1
        if reach > start or not _LETTER(m[0]) or text[end : end + 1].isalnum() or (start and text[start - 1].isalnum()):
            continue
        found.append((start, end))
    return found


def _contexts(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Second last, last and next symbol at each place of a word's parts, edges included."""
    parts = [_SYMBOL_OF[np.frombuffer(p.lower().encode("ascii", "replace"), np.uint8)] for p in _PART.findall(word)]
    s = np.concatenate([np.zeros(2, np.uint8), *(np.append(p, [0, 0]) for p in parts)]).astype(np.int64)
    before, last, next_ = s[:-2], s[1:-1], s[2:]
    # The second edge after a part only begins the next one.
    told = (last > 0) | (next_ > 0)
    return before[told] * (last[told] > 0), last[told], next_[told]


@dataclass
class Chains:
    """ratio: log of random over ordinary odds by (second last, last, next) symbol; threshold: least sum of a secret."""

    ratio: np.ndarray
    threshold: float

    def score(self, word: str) -> float:
        return float(self.ratio[_contexts(word)].sum())


def chain(strings: list[str]) -> np.ndarray:
    """Log odds of each symbol after two others: order two, backed off to order one, backed off to equal odds."""
    two = np.zeros((SYMBOLS, SYMBOLS, SYMBOLS))
    for string in strings:
        np.add.at(two, _contexts(string), 1)
    one = two.sum(axis=0)
    one = (one + BACK_OFF / SYMBOLS) / (one.sum(axis=1, keepdims=True) + BACK_OFF)
    return np.log((two + BACK_OFF * one[None, :, :]) / (two.sum(axis=2, keepdims=True) + BACK_OFF))


def _hash(string: str, secret: bool) -> int:
    return xxhash.xxh64_intdigest(string.encode(), seed=int(secret)) - 2**63


def samples(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Labelled samples: sample STRING, secret BOOLEAN; at most ``sample`` distinct strings of a class, of the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[dict[str, int], dict[str, int]] = ({}, {})

        def shorten() -> None:
            for held in kept:
                if len(held) > sample:
                    best = sorted(held.items(), key=lambda x: (x[1], x[0]))[:sample]
                    held.clear()
                    held.update(best)

        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                valued = _valued(text)
                for _, string in valued:
                    kept[True].setdefault(string, _hash(string, True))
                for start, end in other_words(text, [span for span, _ in valued], LEAST_SAMPLE):
                    string = text[start:end]
                    if string not in kept[False]:
                        kept[False][string] = _hash(string, False)
                if max(map(len, kept)) > 4 * sample:
                    shorten()
        shorten()
        rows = [(string, bool(secret), place) for secret, held in enumerate(kept) for string, place in held.items()]
        if rows:
            strings, secrets, places = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array(secrets, pa.bool_()), pa.array(places, pa.int64())], names=["sample", "secret", "place"])

    text = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"))
    made = text.mapInArrow(run, "sample string, secret boolean, place long").distinct()
    order = Window.partitionBy("secret").orderBy("place", "sample")
    return made.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).select("sample", "secret")


def train(labelled: DataFrame, sample: int = SAMPLE) -> Chains | None:
    """Trains both chains on at most ``sample`` strings of each class; None where a class has none.

    Strings whose label is null, and null strings, are left out; a string of both classes counts in both.
    """
    rows = labelled.where(F.col("sample").isNotNull() & F.col("secret").isNotNull()).select(F.col("sample").cast("string"), "secret").distinct()
    order = Window.partitionBy("secret").orderBy(F.xxhash64("sample"), "sample")
    taken = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).select("sample", "secret").collect()
    random_strings = sorted(r[0] for r in taken if r[1])
    ordinary = sorted((r[0] for r in taken if not r[1]), key=lambda s: (_hash(s, False), s))
    held, learned = ordinary[: len(ordinary) // 4], ordinary[len(ordinary) // 4 :]
    if not random_strings or not learned:
        return None
    chains = Chains(chain(random_strings) - chain(learned), float(np.log(PRIOR_ODDS)))
    judged = sorted(map(chains.score, held), reverse=True)
    if judged:
        chains.threshold = max(chains.threshold, judged[int(FALSE_ALARMS * len(judged))])
    return chains


def added_spans(text: str, base: list[Span], chains: Chains | None) -> list[Span]:
    if chains is None:
        return []
    return [(ADDED, start, end) for start, end in other_words(text, base) if chains.score(text[start:end]) > chains.threshold]


def ordered(spans: list[Span]) -> list[Span]:
    kinds = (*KINDS, ADDED)
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find(docs: DataFrame, chains: Chains | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_assign, n_access, n_hex (base spans), base_sha256, spans (all), n_random for each row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, all_spans, added = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, chains)
                for kind, column in zip(KINDS, counts):
                    column.append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                all_spans.append(written(ordered(base + more)))
                added.append(len(more))
            columns = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(added, pa.int64())], names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_random"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"{id_col} long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_random long")
