"""Operator 6: personal data by base patterns and a skip-chain conditional random field.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone
numbers. The field labels every token that has a digit or an ``@`` with one of
these kinds or none. Its graph per document:

* unary potentials from the token's shape, length, checks and neighbours, a
  softmax trained by stochastic gradient descent;
* chain potentials between such tokens that follow each other;
* skip potentials between tokens of equal or similar content (the same letters
  and digits, or digit strings of which one ends with seven or more digits of
  the other), however far apart, each linked to its previous such token.

Base spans are clamped as evidence. Loopy sum-product messages run over the
whole document; a token whose belief in a kind reaches ``SURE`` becomes an added
span, so that a repeat of a known number is found where it lacks its ``+1`` or
stands right beside another number, which hides both from the base patterns.
Tokens that stay below it, such as numbers that fail their check, are left alone.
A document without a base span has no evidence; its tokens are judged by shape,
neighbours and each other alone. Potentials are trained piece by piece on the base
spans of a bounded sample: ``SAMPLE`` documents with candidates, chosen by a hash
of doc_id, of each of which ``PER_DOC`` tokens and as many edges of either kind,
chosen by a hash of their place over the whole text, reach the driver as feature
numbers, SAMPLE * PER_DOC tokens at most.

Cases: a null text counts as empty: no span, and the digest of an empty string;
a null doc_id is kept; repeated rows are searched each; other columns are left
out. Without training data nothing is added to the base spans. Patterns run in
time linear in the text, also on long runs of digits or letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE = 4000
PER_DOC = 100
FEATURES = 512
SURE = 0.9
#: Seven equal digits say more than the few pairs of a sample can show, so skip potentials count so many times.
SKIP_WEIGHT = 2.0
ROUNDS = 8
TAIL_DIGITS = 7

_MAIL = regex.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# No match can begin inside a run of digits if none begins at its start, so only starts are tried.
_IP = regex.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = regex.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = regex.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = regex.compile(r"[0-9]").search
_TOKEN = regex.compile(r"\S+")
_EDGE = " \t\r\n.,;:!?\"'`#*$%&<>[]{}|=~()"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of each kind, in code points, by kind and start."""
    found: list[Span] = []
    if "@" in text:
        end = 0
        for m in _MAIL.finditer(text):
            at = start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append(("email", start, m.end()))
                end = m.end()
    if not _DIGIT(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


@dataclass
class Token:
    start: int
    end: int
    place: int  # among all tokens of the text
    content: str  # letters and digits, lower-cased
    digits: str
    features: list[int]
    label: int = 0


def _bucket(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % FEATURES


def _shape(word: str) -> str:
    shape = regex.sub("[^0-9a@]+", lambda m: m[0][0], regex.sub(r"\p{L}+", "a", regex.sub("[0-9]+", "0", word)))
    return shape[:24]


def tokens(text: str) -> list[Token]:
    """The candidates of a text, edge punctuation off: tokens with a digit or an ``@``."""
    found, before = [], ""
    for place, m in enumerate(_TOKEN.finditer(text)):
        word = m[0]
        if "@" not in word and not _DIGIT(word):
            before = word
            continue
        core = word.strip(_EDGE)
        start = m.start() + word.index(core)
        digits = "".join(c for c in core if "0" <= c <= "9")
        names = [f"shape {_shape(core)}", f"digits {min(len(digits), 24)}", f"before {before.lower()[:16]}", f"at {'@' in core}", f"plus {core[:1] == '+'}", f"luhn {16 <= len(digits) <= 19 and luhn(digits)}"]
        names.append(f"shape {_shape(core)} luhn {16 <= len(digits) <= 19 and luhn(digits)}")
        octets = core.split(".")
        names.append(f"octets {len(octets) == 4 and all(o.isdecimal() and len(o) < 4 and int(o) < 256 for o in octets)}")
        content = "".join(c for c in core.lower() if c.isalnum() or c == "@")
        if core:
            found.append(Token(start, start + len(core), place, content, digits, [_bucket(n) for n in names]))
        before = word
    return found


def clamp(found: list[Token], spans: list[Span]) -> None:
    """Labels tokens that overlap a base span."""
    for kind, start, end in spans:
        for t in found:
            if t.start < end and start < t.end:
                t.label = LABELS.index(kind)


def edges(found: list[Token]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges and skip edges. A token has one skip edge back per kind of likeness, so their number is linear."""
    chain = [(i - 1, i) for i in range(1, len(found)) if found[i].place - found[i - 1].place == 1]
    skip: set[tuple[int, int]] = set()
    same: dict[str, int] = {}
    tail: dict[str, int] = {}
    for i, t in enumerate(found):
        if t.content in same:
            skip.add((same[t.content], i))
        same[t.content] = i
        if len(t.digits) >= TAIL_DIGITS:
            key = t.digits[-TAIL_DIGITS:]
            j = tail.get(key)
            if j is not None and (t.digits.endswith(found[j].digits) or found[j].digits.endswith(t.digits)):
                skip.add((j, i))
            tail[key] = i
    return chain, sorted(skip)


@dataclass
class Field:
    unary: np.ndarray  # features by labels
    chain: np.ndarray  # labels by labels, log potentials
    skip: np.ndarray


def beliefs(field: Field, found: list[Token], rounds: int = ROUNDS) -> np.ndarray:
    """Marginals per token by loopy sum-product messages; labelled tokens are evidence."""
    k = len(LABELS)
    local = np.array([field.unary[t.features].sum(axis=0) for t in found])
    for i, t in enumerate(found):
        if t.label:
            local[i] = -50.0
            local[i, t.label] = 0.0
    chain, skip = edges(found)
    pairs = [(i, j, field.chain) for i, j in chain] + [(i, j, field.skip) for i, j in skip]
    source = np.array([i for i, j, _ in pairs] + [j for i, j, _ in pairs], int)
    target = np.array([j for i, j, _ in pairs] + [i for i, j, _ in pairs], int)
    weight = np.array([p for _, _, p in pairs] + [p.T for _, _, p in pairs]).reshape(-1, k, k)
    message, half = np.zeros((len(source), k)), len(pairs)
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)]) if half else np.empty(0, int)
    for _ in range(rounds if half else 0):
        total = local.copy()
        np.add.at(total, target, message)
        out = (total[source] - message[back])[:, :, None] + weight
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    total = local.copy()
    if half:
        np.add.at(total, target, message)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], field: Field | None) -> list[Span]:
    """Spans of the field beside the base ones; phone tokens with a single space between are one span."""
    if field is None:
        return []
    found = tokens(text)
    clamp(found, base)
    if all(t.label for t in found):
        return []
    odds = beliefs(field, found)
    spans: list[Span] = []
    for t, p in zip(found, odds):
        best = int(p.argmax())
        if t.label or not best or p[best] < SURE:
            continue
        kind = LABELS[best]
        if spans and spans[-1][0] == kind == "phone" and t.start - spans[-1][2] == 1:
            spans[-1] = (kind, spans[-1][1], t.end)
        else:
            spans.append((kind, t.start, t.end))
    return spans


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def spread(n: int) -> list[int]:
    """PER_DOC of the numbers below ``n`` at most, by a hash; a document of very many tokens would crowd out the others in the fit."""
    if n <= PER_DOC:
        return list(range(n))
    places = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.sort(np.argsort(places ^ (places >> np.uint64(29)), kind="stable")[:PER_DOC]).tolist()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field | None:
    """Piecewise training: a softmax on token features, and pair potentials as log odds of how labels meet over chain and skip edges."""
    text = F.col(text_col).cast("string")
    sized = docs.where(F.col(id_col).isNotNull())
    count = sized.count()
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("pii")), F.lit(1_000_000))
    # About a tenth of texts hold candidates; ten times the sample is looked at.
    chosen = sized.where(place < int(min(1.0, 10 * sample / max(1, count)) * 1_000_000)).where(text.rlike("[0-9@]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, features, pairs = [], [], []
            for value in batch.column(0).to_pylist():
                found = tokens(value)
                clamp(found, base_spans(value))
                chain, skip = edges(found)
                own = [found[i] for i in spread(len(found))]
                labels.append([t.label for t in own])
                features.append([f for t in own for f in t.features])
                # A token like a labelled one is unknown rather than none, so it says nothing about skips.
                skip = [(i, j) for i, j in skip if bool(found[i].label) == bool(found[j].label)]
                pairs.append([25 * kind + 5 * found[es[e][0]].label + found[es[e][1]].label for kind, es in enumerate((chain, skip)) for e in spread(len(es))])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.list_(pa.int8())), pa.array(features, pa.list_(pa.int16())), pa.array(pairs, pa.list_(pa.int16()))], names=["labels", "features", "pairs"])

    made = chosen.select(text.alias("t")).mapInArrow(run, "labels array<byte>, features array<short>, pairs array<short>")
    rows = made.where(F.size("labels") > 0).orderBy(F.xxhash64("labels", "features")).limit(sample).toArrow()
    labels = np.array([x for row in rows["labels"].to_pylist() for x in row], int)
    if not len(labels):
        return None
    features = np.array([x for row in rows["features"].to_pylist() for x in row], int).reshape(len(labels), -1)
    pairs = np.array([x for row in rows["pairs"].to_pylist() for x in row], int)
    unary, rng = np.zeros((FEATURES, len(LABELS))), np.random.default_rng(11)
    for epoch in range(10):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 64):
            rows_ = order[at : at + 64]
            logits = unary[features[rows_]].sum(axis=1)
            error = np.exp(logits - logits.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(rows_)), labels[rows_]] -= 1
            np.add.at(unary, features[rows_], -(0.1 / (1 + epoch)) * error[:, None, :])
        unary *= 1 - 1e-3
    tables, alone = [], np.bincount(labels, minlength=5) + 1.0
    alone /= alone.sum()
    for kind in range(2):
        own = pairs[(pairs >= 25 * kind) & (pairs < 25 * kind + 25)] - 25 * kind
        seen = np.bincount(own, minlength=25).reshape(5, 5)
        # What few pairs say counts little: chains lean to independence, skips halfway to one shared label.
        prior = np.outer(alone, alone) if kind == 0 else 0.5 * np.outer(alone, alone) + 0.5 * np.diag(alone)
        joint = seen + seen.T + 20 * prior
        joint /= joint.sum()
        tables.append(np.log(joint) - np.log(joint.sum(axis=1, keepdims=True)) - np.log(joint.sum(axis=0, keepdims=True)))
    return Field(unary, tables[0], SKIP_WEIGHT * tables[1])


def find(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added for each row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, all_spans, added = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, field)
                for kind, column in zip(KINDS, counts):
                    column.append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(written(ordered(base)).encode()).hexdigest())
                all_spans.append(written(ordered(base + more)))
                added.append(len(more))
            columns = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(added, pa.int64())], names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"{id_col} long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")


def masked_text(text: str | None, field: Field | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are replaced together, named by the first."""
    if not text or not ("@" in text or _DIGIT(text)):
        return text
    base = base_spans(text)
    spans = sorted(base + added_spans(text, base, field), key=lambda s: (s[1], -s[2]))
    if not spans:
        return text
    parts, end = [], 0
    for kind, start, stop in spans:
        if start >= end:
            parts += [text[end:start], f"<{kind}>"]
        end = max(end, stop)
    return "".join([*parts, text[end:]])


def mask(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked in ``text_col``; all rows and columns stay."""

    @F.pandas_udf("string")
    def masked(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: masked_text(t, field), na_action="ignore")

    return docs.withColumn(text_col, masked(F.col(text_col).cast("string")))
