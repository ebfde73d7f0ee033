"""Operator 13: phrase collocations by dictionary codes, range-partitioned radix sort and run-length counts.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends,
and pieces into words at spaces and tabs. Everything is counted per language.

1. Words are counted; the frequent ones (``least`` times or more, as every word
   of a frequent phrase is) get dense numbers, one for each word of a language.
2. Pieces break at other words. Each place in what is left gives one key: the
   numbers of its word and of up to three that follow, ``ID_BYTES`` bytes each,
   zeros where the piece ends. Tasks sort their keys by radix and send each with
   its count, so a common phrase costs a task one row.
3. Sorted keys are dealt by range, between keys of a sample of texts, and sorted
   by radix again. A task sends each range's part of its keys as one row. Phrases
   of two, three and four words are runs of equal prefixes, counted by their
   lengths. Only the runs at the edges of a range can go on in another; these
   alone are summed once more, so a phrase of any frequency is spread over tasks.
4. A candidate loses against a longer one that holds it often enough; the others
   are scored at each cut by two lookups of exact counts, and ranked.

The dictionary is broadcast only while a count says that it has at most
``broadcast_words`` words. Beyond that, texts are dealt in blocks of bounded
size, each block's distinct words are joined with the dictionary, and a block
meets its own part of it.

Cases: null texts count as empty, a null language as ``und``; repeated rows count
each; pieces without words give nothing; an empty table, or one without frequent
phrases, gives no row; other columns are left out. Counts and scores are exact:
products are decimals of 38 digits. Ranges hold ``KEYS`` keys on average; the
sample, about ``SAMPLED_KEYS`` keys, only says where they begin.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.components import BROADCAST_KEYS, spread_join
from veritrail.llm.lineage import written

LEAST, LONGEST, FIRST = 30, 4, 2000
#: A phrase is dropped if a longer one has so many hundredths of its occurrences.
ABSORBED = 80
ID_BYTES = 5
BROADCAST_WORDS = 500_000
#: Words and keys that a task holds at once, bytes of a block of texts, and keys of a partition.
WORDS_HELD, KEYS_HELD, BLOCK_BYTES, KEYS = 500_000, 1_000_000, 4_000_000, 1_000_000
SAMPLED_KEYS, SALTS = 300_000, 256
WIDTH = LONGEST * ID_BYTES

_NORMAL = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    kept = docs.where(F.col(text_col).isNotNull())
    return kept.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, normal texts joined by line ends); texts of BLOCK_BYTES or little more are held at once."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = value.as_buffer().to_pybytes().lower().translate(_NORMAL)
            held.setdefault(lang, []).append(data)
            size += len(data)
            if size >= BLOCK_BYTES:
                yield from ((own, b"\n".join(texts)) for own, texts in held.items())
                held, size = {}, 0
    yield from ((own, b"\n".join(texts)) for own, texts in held.items())


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang STRING, word STRING, f LONG of every word; partial counts are summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, Counter[bytes]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, words in counted.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.binary()).cast(pa.string()), pa.array(words.values(), pa.int64())], names=["lang", "word", "f"])
            counted.clear()

        for lang, data in _blocks(batches):
            counted.setdefault(lang, Counter()).update(data.split())
            if sum(map(len, counted.values())) > WORDS_HELD:
                yield from flushed()
        yield from flushed()

    return _texts(docs, text_col, lang_col).mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def dictionary(counts: DataFrame, least: int) -> DataFrame:
    """lang, word, f, id BINARY of the frequent words; numbers are dense and begin at 1.

    They follow the rows of a written table: its partitions are counted, and each starts where the last one ends.
    """
    low = (1 << 33) - 1
    rows = written(counts.where(F.col("f") >= least).select("lang", "word", "f", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(low).alias("_i")), "words")
    starts, start = [], 1
    for p, n in rows.groupBy("_p").count().orderBy("_p").collect():
        starts.append((p, start))
        start += n
    if start > 1 << (8 * ID_BYTES):
        raise OverflowError("more frequent words than an id can number")
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_p int, _start long"))
    number = F.hex(F.col("_start") + F.col("_i"))
    return rows.join(offsets, "_p").select("lang", "word", "f", F.unhex(F.lpad(number, 2 * ID_BYTES, "0")).alias("id"))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of fixed-width keys (rows of bytes): one stable counting pass for two bytes, the last ones first."""
    digits = np.ascontiguousarray(keys).view(">u2").astype(np.uint16)
    order = np.arange(len(keys))
    for column in reversed(range(digits.shape[1])):
        digit = digits[:, column]
        if len(digit) and digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def starts_of_runs(keys: np.ndarray, width: int) -> np.ndarray:
    """Places where the first ``width`` bytes of sorted keys change."""
    changed = (keys[1:, :width] != keys[:-1, :width]).any(axis=1)
    return np.concatenate([[0], np.flatnonzero(changed) + 1])


def keys_of(data: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    """One key for each place of a block where two frequent words follow each other."""
    words = list(filter(None, data.replace(b"\n", b" \n ").split(b" ")))
    ids = np.zeros(len(words) + LONGEST - 1, np.int64)
    ids[: len(words)] = np.fromiter(map(numbers.get, words, repeat(0)), np.int64, len(words))
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    keys, goes_on = np.empty((len(at), LONGEST, ID_BYTES), np.uint8), np.ones(len(at), bool)
    for place in range(LONGEST):
        here = ids[at + place]
        goes_on &= here > 0
        keys[:, place] = np.where(goes_on, here, 0).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - ID_BYTES :]
    return keys.reshape(-1, WIDTH)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


#: What an encoding task sends: a range's number, its distinct keys in order, and their counts.
PACKED = "part int, keys binary, n binary"


def _packed(held: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorts and counts keys, and packs those of each range; ``starts`` are the first keys of all ranges but the first."""
    keys = np.concatenate(held)
    keys = keys[radix_order(keys)]
    first = starts_of_runs(keys, WIDTH)
    n = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    cuts = [0, *np.searchsorted(_comparable(keys), _comparable(starts)).tolist(), len(keys)]
    parts = [p for p in range(len(cuts) - 1) if cuts[p] < cuts[p + 1]]
    for low in range(0, len(parts), 64):
        some = parts[low : low + 64]
        columns = [pa.array(some, pa.int32()), *(pa.array([x[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary()) for x in (keys, n.astype("<i8")))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "keys", "n"])


def _comparable(keys: np.ndarray) -> np.ndarray:
    """Keys as byte strings, which numpy compares like their rows."""
    return np.ascontiguousarray(keys).view(f"S{WIDTH}").reshape(-1)


def _encoded(blocks: Iterator[tuple[bytes, dict[bytes, int]]], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for data, numbers in blocks:
        keys = keys_of(data, numbers)
        if len(keys):
            held.append(keys)
        if sum(map(len, held)) >= KEYS_HELD:
            yield from _packed(held, starts)
            held = []
    if held:
        yield from _packed(held, starts)


class Numbers:
    """Words and their numbers by language; tables of a worker are made when first asked for."""

    def __init__(self, words: pa.Table) -> None:
        self.words = words
        self.tables: dict[str, dict[bytes, int]] | None = None

    def of(self, lang: str) -> dict[bytes, int]:
        if self.tables is None:
            self.tables = {}
            for own, word, code in zip(self.words["lang"].to_pylist(), self.words["word"].cast(pa.binary()).to_pylist(), self.words["id"].to_pylist()):
                self.tables.setdefault(own, {})[word] = int.from_bytes(code)
        return self.tables.get(lang, {})


Encode = Callable[[DataFrame, np.ndarray], DataFrame]


def _by_broadcast(words: DataFrame) -> Encode:
    numbers = words.sparkSession.sparkContext.broadcast(Numbers(words.select("lang", "word", "id").toArrow()))

    def encode(texts: DataFrame, starts: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _encoded(((data, numbers.value.of(lang)) for lang, data in _blocks(batches)), starts)

        return texts.mapInArrow(run, PACKED)

    return encode


def _by_blocks(words: DataFrame, broadcast_keys: int) -> Encode:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, (lang, data) in enumerate(_blocks(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{i}"]), pa.array([lang], pa.string()), pa.array([data], pa.binary())], names=["block", "lang", "data"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, data in zip(*(c.to_pylist() for c in batch.columns)):
                found = pa.array(set(data.split()), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.string()), pa.array([lang] * len(found), pa.string()), found], names=["block", "lang", "word"])

    # A word has no space, so word and language are told apart.
    key = F.concat_ws(" ", "word", "lang").alias("_w")

    def encode(texts: DataFrame, starts: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def each() -> Iterator[tuple[bytes, dict[bytes, int]]]:
                for batch in batches:
                    for data, held in zip(batch.column("data"), batch.column("held")):
                        own = held.values
                        named = own.field("word").cast(pa.binary()).to_pylist()
                        yield data.as_py(), {w: int.from_bytes(code) for w, code in zip(named, own.field("id").to_pylist())}

            yield from _encoded(each(), starts)

        dealt = written(texts.mapInArrow(blocks, "block string, lang string, data binary"), "blocks")
        keyed = words.select(key, "id", F.col("f").alias("_n"))
        of_block = spread_join(dealt.mapInArrow(distinct, "block string, lang string, word string").select("block", "word", key), keyed, "_w", broadcast_keys)
        held = of_block.groupBy("block").agg(F.collect_list(F.struct("word", "id")).alias("held"))
        return dealt.join(held, "block").select("data", "held").mapInArrow(run, PACKED)

    return encode


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (b"".join(batch.column(c).to_pylist()) for c in ("keys", "n"))
    return np.frombuffer(keys, np.uint8).reshape(-1, WIDTH), np.frombuffer(n, "<i8")


def range_starts(texts: DataFrame, encode: Encode, places: int) -> np.ndarray:
    """First keys of all ranges but the first, from a sample of texts; there is a range for each KEYS places."""
    ranges = max(1, -(-places // KEYS))
    whole = np.empty((0, WIDTH), np.uint8)
    if ranges == 1:
        return whole
    sampled = encode(texts.sample(min(1.0, SAMPLED_KEYS / places), seed=13), whole).toArrow()
    keys = np.frombuffer(b"".join(sampled["keys"].to_pylist()), np.uint8).reshape(-1, WIDTH)
    keys = keys[radix_order(keys)]
    return np.unique(_comparable(keys[np.arange(1, ranges) * len(keys) // ranges])).view(np.uint8).reshape(-1, WIDTH) if len(keys) else whole


def runs(packed: DataFrame, least: int, ranges: int) -> DataFrame:
    """key BINARY, m INT, f LONG of phrases of two to LONGEST words that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpacked(batch) for batch in batches if batch.num_rows]
        if not held:
            return
        table, n = np.concatenate([keys for keys, _ in held]), np.concatenate([n for _, n in held])
        del held
        order = radix_order(table)
        table, n = table[order], n[order]
        for m in range(2, LONGEST + 1):
            starts = starts_of_runs(table, m * ID_BYTES)
            f = np.add.reduceat(n, starts)
            edge = np.zeros(len(starts), bool)
            edge[[0, -1]] = True
            whole = table[starts, (m - 1) * ID_BYTES : m * ID_BYTES].any(axis=1)
            kept = whole & (edge | (f >= least))
            found = table[starts[kept], : m * ID_BYTES]
            yield pa.RecordBatch.from_arrays([_binary(found), pa.array(np.full(len(found), m), pa.int32()), pa.array(f[kept], pa.int64()), pa.array(edge[kept])], names=["key", "m", "f", "edge"])

    made = written(packed.repartitionById(ranges, "part").mapInArrow(run, "key binary, m int, f long, edge boolean"), "runs")
    across = made.where("edge").groupBy("key", "m").agg(F.sum("f").alias("f"))
    return made.where("NOT edge").select("key", "m", "f").union(across.where(F.col("f") >= least))


def _absorbed(grams: DataFrame) -> DataFrame:
    """key, most: for phrases within longer candidates the count of the most frequent one."""
    places = [(at, size) for size in range(2, LONGEST) for at in range(LONGEST - size + 1)]
    parts = [F.when((F.col("m") > size) & (F.col("m") >= at + size), F.substring("key", at * ID_BYTES + 1, size * ID_BYTES)) for at, size in places]
    return grams.where("m > 2").select(F.explode(F.array(*parts)).alias("key"), "f").where("key IS NOT NULL").groupBy("key").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, first: int = FIRST, broadcast_words: int = BROADCAST_WORDS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Returns lang, rank, phrase, a, l, r, n, score: the ``first`` phrases of each language by score, frequency and bytes."""
    counts = written(word_counts(docs, text_col, lang_col), "counts")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = written(dictionary(counts, least), "dictionary")
    known, places = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))).first()
    texts = _texts(docs, text_col, lang_col)
    encode = _by_broadcast(words) if known <= broadcast_words else _by_blocks(words, broadcast_keys)
    starts = range_starts(texts, encode, places)
    grams = written(runs(encode(texts, starts), least, len(starts) + 1), "grams")

    kept = grams.join(_absorbed(grams), "key", "left").where(F.coalesce(F.col("most") * 100 < F.col("f") * ABSORBED, F.lit(True)))
    cuts = kept.select("key", "m", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr(f"substring(key, 1, k * {ID_BYTES})"), "right": F.expr(f"substring(key, k * {ID_BYTES} + 1)")})
    # Each of the three lengths that a part can begin or end occurs least times, which bounds its candidates.
    rows_of = (F.col("f") * LONGEST / least).cast("long").alias("_n")
    parts = written(grams.select("key", "f", F.lit(None).cast("string").alias("lang"), rows_of).union(words.select(F.col("id").alias("key"), "f", "lang", rows_of)), "parts")
    found = spread_join(cuts, parts.select(F.col("key").alias("left"), F.col("f").alias("l"), "lang", "_n"), "left", broadcast_keys).drop("_n")
    found = spread_join(found, parts.select(F.col("key").alias("right"), F.col("f").alias("r"), "_n"), "right", broadcast_keys)
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS LONG)")
    lowest = found.select("key", "a", "lang", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("key", "a").agg(F.min("cut").alias("cut"), F.max("lang").alias("lang"))
    scored = lowest.select("key", "lang", "a", "cut.l", "cut.r", "cut.score")

    # Ties are settled by the words, so only phrases that can still be among the first are spelled out.
    by_lang = Window.partitionBy("lang")
    # One language may have nearly all of them: the first of each of SALTS groups are found before those of the whole.
    best = [F.desc("score"), F.desc("a")]
    dealt = scored.withColumn("_s", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    few = dealt.withColumn("_r", F.rank().over(Window.partitionBy("lang", "_s").orderBy(*best))).where(F.col("_r") <= first)
    near = written(few.withColumn("_r", F.rank().over(by_lang.orderBy(*best))).where(F.col("_r") <= first).drop("_r", "_s"), "near")
    ids = near.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("key") / ID_BYTES).cast("int") - 1), lambda i: F.substring(F.col("key"), i * ID_BYTES + 1, F.lit(ID_BYTES)))).alias("place", "id"))
    spelled = spread_join(ids, words.select("id", "word", F.lit(1).cast("long").alias("_n")), "id", broadcast_keys).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    phrases = near.join(spelled, "key").withColumn("phrase", F.array_join("w.word", " "))
    ranked = phrases.withColumn("rank", F.row_number().over(by_lang.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def duckdb_sql(least: int = LEAST, first: int = FIRST) -> str:
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE "text" IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM q, (VALUES (1), (2), (3), (4)) AS sizes(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= {least}),
part AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS most FROM c, (VALUES (2), (3)) AS sizes(s), (VALUES (1), (2), (3)) AS places(i) WHERE s < m AND i + s - 1 <= m GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN part USING (lang, phrase) WHERE most IS NULL OR 100 * most < {ABSORBED} * c.a),
cuts AS (SELECT kept.lang, kept.phrase, kept.a, k, fl.a AS l, fr.a AS r, CAST((2000000::HUGEINT * kept.a) // (fl.a + fr.a) AS BIGINT) AS score
  FROM kept JOIN (VALUES (1), (2), (3)) AS cut(k) ON k < kept.m
  JOIN f AS fl ON fl.lang = kept.lang AND fl.phrase = array_to_string(ws[1:k], ' ') JOIN f AS fr ON fr.lang = kept.lang AND fr.phrase = array_to_string(ws[k + 1:kept.m], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS "rank" FROM best)
SELECT lang, "rank", phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE "rank" <= {first}"""
