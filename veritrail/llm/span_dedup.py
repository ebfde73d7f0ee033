"""Operator 2: substring dedup over sliding sentence spans.

A text is cut into sentences: after a word that ends in ``.``, ``!``, ``?``, an
ellipsis or a CJK full stop (up to ``CLOSERS`` closing quotes and brackets may
follow), and at line breaks. A sentence of over ``LONGEST`` words is cut further
at places that depend on its words alone: after every word that is the longest
(the last of equally long ones) of some ``CUT_WINDOW`` words in a row. Wherever
a passage stands, it is so cut at the same places, save near its ends.

A run is the fewest consecutive sentences from one on that are ``SPAN`` or more
and hold ``LEAST_WORDS`` words or more. Every run is hashed on its lower-cased
words and joined with all other runs of the table. A hash that occurs more than
once has one first occurrence, by (doc_id, place in the text); sentences covered
by any other occurrence are removed, the rest of the text stays as it is.

A passage of over 50 words always holds a run of its own: at most LONGEST words
are lost at either end (a shorter sentence that the passage begins within, or the
words up to the first full window), and the 35 or more left hold a run, as three
sentences have 3 * LONGEST = 24 words at most and a run of more ends within
LEAST_WORDS + LONGEST - 1 = 35. For this count each word is one; a run
counts a word of over 24 bytes once for every 24 begun, for texts without spaces.

Returns doc_id, text (what is left), n_sentences, n_removed for each row.

Cases: a null text stays null with no sentences; an empty one stays empty; a
text whose sentences all go becomes empty; a null doc_id sorts before all
others; rows that share doc_id and text are one document to the search, so
they do not remove each other, and each is returned; repeats within one text
count like those between texts; other columns are left out.

Scale: a first pass counts 64 bits of every run with map-side combine. A second one
keeps the runs whose 64 bits occur more than once; these are broadcast, as bare
numbers, while a bounded count says that they are few, and shuffled beyond that.
Only what is left meets by all 128 bits, with the first occurrence of each written
before, so that Spark may split the runs of a hot hash over tasks. The text is
shuffled once, by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.lineage import cut

SPAN = 3
LEAST_WORDS = 28
LONGEST = 8
CUT_WINDOW = 8
CLOSERS = 16
WORD_BYTES = 24
BROADCAST_RUNS = 4_000_000
_STOP, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSE[list(b"\"')]}")] = True
#: For each byte whether it is white space, or a line break.
_SPACE = bytes(b in b"\t\n\x0b\f\r " for b in range(256))
_BREAK = bytes(b in b"\n\r" for b in range(256))
#: Stops and closing quotes of several bytes in UTF-8.
_LONG_STOPS, _LONG_CLOSE = [c.encode() for c in "…。！？"], [c.encode() for c in "”’»"]


@dataclass
class Cut:
    raw: bytes
    first: np.ndarray  # where each sentence begins in ``raw``; the last entry is the end
    words: bytes  # lower-cased, single spaces
    begin: np.ndarray  # where each sentence begins and ends in ``words``
    end: np.ndarray
    size: np.ndarray  # words of each sentence


def _ends_with(raw: np.ndarray, at: np.ndarray, mark: bytes) -> np.ndarray:
    """Whether ``mark`` stands in ``raw`` up to each place, the place included."""
    fits = at >= len(mark) - 1
    for k, byte in enumerate(reversed(mark)):
        fits &= raw[np.maximum(at - k, 0)] == byte
    return fits


def _stops(raw: bytes, data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which words end a sentence; ``last`` is the place of each word's last byte."""
    at, longer = last, [m for m in _LONG_CLOSE if m in raw]
    for _ in range(CLOSERS):
        step = _CLOSE[data[at]].astype(np.int64)
        for mark in longer:
            step = np.where(_ends_with(data, at, mark), len(mark), step)
        if not step.any():
            break
        at = np.maximum(at - step, 0)
    found = _STOP[data[at]]
    for mark in _LONG_STOPS:
        if mark in raw:
            found |= _ends_with(data, at, mark)
    return found


def sentences(text: str) -> Cut | None:
    """The sentences of a text; None if it has no word."""
    raw, low = text.encode(), text.lower().encode()
    data = np.frombuffer(raw, np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = np.frombuffer(raw.translate(_SPACE), bool)
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, stop = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return None
    words = low.split()
    # Lower case can change how long a word is, but seldom does.
    same = len(low) == len(raw) and low.translate(_SPACE) == raw.translate(_SPACE)
    sizes = stop - start if same else np.fromiter(map(len, words), np.int64, n)
    ends = _stops(raw, data, stop - 1)
    ends[np.searchsorted(stop, np.flatnonzero(np.frombuffer(raw.translate(_BREAK), bool)), side="right") - 1] = True  # before the first word: the last, which ends anyway
    ends[-1] = True
    of = np.cumsum(ends) - ends
    if n >= CUT_WINDOW and CUT_WINDOW == 8:
        key = (sizes << 32) + np.arange(n)
        for shift in (1, 2, 4):
            key = np.maximum(key[:-shift], key[shift:])
        inside = (of[: n - 7] == of[7:]) & (np.bincount(of)[of[: n - 7]] > LONGEST)
        ends[key[inside] & 0xFFFFFFFF] = True
    last = np.flatnonzero(ends)
    head = np.append(0, last[:-1] + 1)
    place = np.cumsum(sizes + 1)
    weights = np.append(0, np.cumsum((sizes + (WORD_BYTES - 1)) // WORD_BYTES))
    return Cut(raw, np.append(start[head], len(raw)), b" ".join(words), place[head] - sizes[head] - 1, place[last] - 1, weights[last + 1] - weights[head])


def run_ends(size: np.ndarray) -> np.ndarray:
    """For each sentence that begins a run the run's last sentence; the others, at the end of the text, have none."""
    total = np.cumsum(size)
    last = np.maximum(np.searchsorted(total, total - size + LEAST_WORDS), np.arange(len(size)) + (SPAN - 1))
    return last[last < len(size)]


def runs(docs: DataFrame) -> DataFrame:
    """docs: id, hash, text. One row per run: id, hash, pos (of its first sentence, from 0), h1, h2 (128 bits of its words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            counts, hashes = np.zeros(batch.num_rows, np.int64), []
            for k, text in enumerate(batch.column(2)):
                made = sentences(text.as_py()) if text.is_valid else None
                if made is not None:
                    last = run_ends(made.size)
                    counts[k] = len(last)
                    hashes += [digest(made.words[a:b]) for a, b in zip(made.begin[: len(last)].tolist(), made.end[last].tolist())]
            rows = np.repeat(np.arange(batch.num_rows), counts)
            halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            pos = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(pos.astype(np.int32)), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["id", "hash", "pos", "h1", "h2"])

    return docs.select("id", "hash", "text").mapInArrow(run, "id long, hash long, pos int, h1 long, h2 long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    found = runs(rows)
    place = F.struct("id", "hash", "pos")
    # The first half of the hash alone tells which runs can be repeated, in narrow rows.
    often = cut(found.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"))
    if often.limit(broadcast_runs + 1).count() <= broadcast_runs:
        often = F.broadcast(often)
    again = cut(found.join(often, "h1", "left_semi"))
    repeated = again.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first")
    repeated = cut(repeated)  # a plain input of the join, which leaves Spark free to split a hot hash
    later = again.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    key = [F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("key"), "hash"]
    gone = later.select(*key, "pos").groupBy("no_id", "key", "hash").agg(F.collect_set("pos").alias("starts"))
    joined = rows.select(*key, "id", "text").join(gone, ["no_id", "key", "hash"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_all, n_gone = [], [], []
            for text, starts in zip(batch.column(1), batch.column(2)):
                value, made = text.as_py(), None
                if value:
                    made = sentences(value)
                n_all.append(0 if made is None else len(made.size))
                if made is None or not starts.is_valid:
                    texts.append(value)
                    n_gone.append(0)
                    continue
                marks, last, begin = np.zeros(len(made.size) + 1, np.int64), run_ends(made.size), np.asarray(starts.values)
                np.add.at(marks, begin, 1)
                np.add.at(marks, last[begin] + 1, -1)
                covered = np.cumsum(marks[:-1]) > 0
                n_gone.append(int(covered.sum()))
                kept = [made.raw[a:b] for a, b in zip(made.first[:-1][~covered].tolist(), made.first[1:][~covered].tolist())]
                texts.append(b"".join([made.raw[: made.first[0]], *kept]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_all, pa.int64()), pa.array(n_gone, pa.int64())], names=[id_col, "text", "n_sentences", "n_removed"])

    return joined.select("id", "text", "starts").mapInArrow(run, f"{id_col} long, text string, n_sentences long, n_removed long")


def duckdb_sql() -> str:
    space = r"[ \t\n\x0B\f\r]"
    word = r"[^ \t\n\x0B\f\r]"
    stop = rf"[.!?…。！？][\"'')\]}}”’»]{{0,{CLOSERS}}}$"
    window = f"ORDER BY i ROWS BETWEEN CURRENT ROW AND {CUT_WINDOW - 1} FOLLOWING"
    return rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS d, text, regexp_extract_all(coalesce(text, ''), '{word}+{space}*') AS parts FROM documents),
w0 AS (SELECT d, doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM t),
w1 AS (SELECT d, doc_id, i, part, regexp_extract(part, '^{word}+') AS w FROM w0),
w2 AS (SELECT *, regexp_matches(w, '{stop}') OR regexp_matches(part, '[\n\r]') AS ends, strlen(lower(w)) AS k FROM w1),
w3 AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w2),
c AS (SELECT DISTINCT d, best % 4294967296 AS i FROM (SELECT d, max(k * 4294967296 + i) OVER (PARTITION BY d, s {window}) AS best, count(*) OVER (PARTITION BY d, s {window}) AS m, count(*) OVER (PARTITION BY d, s) AS n FROM w3) WHERE m = {CUT_WINDOW} AND n > {LONGEST}),
w4 AS (SELECT w3.*, ends OR c.i IS NOT NULL AS final FROM w3 LEFT JOIN c ON w3.d = c.d AND w3.i = c.i),
w5 AS (SELECT *, coalesce(sum(final::INT) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS u FROM w4),
u AS (SELECT d, any_value(doc_id) AS doc_id, u, string_agg(part, '' ORDER BY i) AS raw, string_agg(lower(w), ' ' ORDER BY i) AS low, sum((k + {WORD_BYTES - 1}) // {WORD_BYTES})::BIGINT AS n FROM w5 GROUP BY d, u),
v AS (SELECT *, sum(n) OVER (PARTITION BY d ORDER BY u)::BIGINT AS total, max(u) OVER (PARTITION BY d) AS top FROM u),
e AS (SELECT a.d, a.doc_id, a.u, greatest(b.u, a.u + {SPAN - 1}) AS last, a.top FROM v AS a ASOF JOIN v AS b ON a.d = b.d AND a.total - a.n + {LEAST_WORDS} <= b.total),
r AS (SELECT e.d, e.doc_id, e.u, e.last, string_agg(u.low, ' ' ORDER BY u.u) AS h FROM e JOIN u ON u.d = e.d AND u.u BETWEEN e.u AND e.last WHERE e.last <= e.top GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, u) AS place FROM r),
g AS (SELECT DISTINCT f.d, u.u FROM f JOIN u ON u.d = f.d AND u.u BETWEEN f.u AND f.last WHERE place > 1),
l AS (SELECT u.d, count(*) AS n_sentences, count(g.u) AS n_removed, string_agg(raw, '' ORDER BY u.u) FILTER (g.u IS NULL) AS rest FROM u LEFT JOIN g ON u.d = g.d AND u.u = g.u GROUP BY u.d)
SELECT doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN text ELSE regexp_extract(text, '^{space}*') || coalesce(rest, '') END AS text, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed
FROM t LEFT JOIN l USING (d)"""
