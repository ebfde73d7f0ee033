"""Operator 9: SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits are linked at ``MOST_BITS`` = 4 or fewer differing
bits. Each differing bit spoils one of eight bytes at most, so linked
fingerprints share at least four positional bytes. A posting list of one
positional byte would hold a 256th of all fingerprints, so the index is keyed
by three positional bytes at a time: 20 position triples are enough for every
set of four positions to contain one (the Turan bound for 8, 4 and 3). Within a
posting list the shared positional bytes of each pair are tallied, pairs that
reach four are kept, and these are verified by counting differing bits.

Only distinct fingerprints enter the index, so exact copies cost nothing; they
meet their class at the end, which is broadcast while a bounded count says that
there are few classes, and beyond that shuffled, hot fingerprints in several copies. A
posting list of over ``BLOCK`` fingerprints is dealt in blocks over tasks,
every pair of blocks meeting in one of them; no list is cut short. A task emits
a spanning star for each connected part of a list, never all its pairs.

Cases: null and empty texts and texts without words have fingerprint zero and
are linked like any other; repeated rows are returned each; a null doc_id is
kept and never names a component unless all of its documents lack an id; other
columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm import components
from veritrail.llm.lineage import cut

MOST_BITS = 4
SHINGLE = 4
SEED = 42
BLOCK = 8192
SMALL = 32
#: Bits are counted for so many shingles at once, so a long text takes bounded memory.
CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    total = len(first)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        spans = zip(first[at : at + CHUNK], last[at : at + CHUNK])
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, min(CHUNK, total - at))
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, text_hash and fp (the fingerprint as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=[id_col, "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.xxhash64(text).alias("text_hash"), text.alias("_text"))
    return rows.mapInArrow(run, f"{id_col} long, text_hash long, fp long")


def position_triples() -> list[tuple[int, int, int]]:
    """20 triples of byte positions such that any four positions contain one: three groups in a ring; a triple lies in a group, or two in one and one in the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    kept = []
    for triple in combinations(range(8), 3):
        own = [group[p] for p in triple]
        if len(set(own)) == 1 or any(own.count(g) == 2 and (g + 1) % 3 in own for g in range(3)):
            kept.append(triple)
    return kept


def _postings(prints: DataFrame) -> DataFrame:
    """(fp) to one row per position triple: key, fp."""
    keys = []
    for k, triple in enumerate(position_triples()):
        key = F.lit(k).cast("long")
        for p in triple:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")))
        keys.append(key)
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def _linked(x: np.ndarray) -> np.ndarray:
    """From XORs of fingerprints: at least four zero bytes (shared positions), then at most MOST_BITS differing bits."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    zero_bytes = ~(((x & low) + low) | x | low)  # the top bit of each byte that is zero
    return (np.bitwise_count(zero_bytes) >= 8 - MOST_BITS) & (np.bitwise_count(x) <= MOST_BITS)


def _stars(left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the linked parts within ``left``, or between ``left`` and ``right``."""
    other = left if right is None else right
    near = np.empty((len(left), len(other)), bool)
    for at in range(0, len(left), 256):
        near[at : at + 256] = _linked(left[at : at + 256, None] ^ other[None, :])
    if right is None:
        np.fill_diagonal(near, False)
    ends, hubs = [], []
    open_left = near.any(axis=1)
    seen_right = np.zeros(len(other), bool)
    while open_left.any():
        start = int(open_left.argmax())
        rows, seen = np.array([start]), np.zeros(len(left), bool)
        seen[start] = True
        reached = np.zeros(len(other), bool)
        while len(rows):
            new = near[rows].any(axis=0) & ~seen_right
            seen_right |= new
            reached |= new
            if right is None:
                found = new & ~seen
            else:
                found = near[:, new].any(axis=1) & ~seen if new.any() else np.zeros(len(left), bool)
            seen |= found
            rows = np.flatnonzero(found)
        open_left &= ~seen
        members = left[seen] if right is None else np.concatenate([left[seen], right[reached]])
        members = members[members != left[start]]
        ends.append(members)
        hubs.append(np.full(len(members), left[start]))
    none = np.empty(0, np.uint64)
    return (np.concatenate(ends), np.concatenate(hubs)) if ends else (none, none)


def _links_of(key: np.ndarray, side: np.ndarray, pair: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal (key, pair); rows are sorted by both. side: the block of a row, 0 or 1."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(key)))
    one, two = [], []
    small = np.repeat(sizes <= SMALL, sizes) & (side == 2)
    run, prints = np.repeat(np.arange(len(starts)), sizes)[small], fp[small]
    for step in range(1, SMALL):
        same = run[step:] == run[:-step]
        if not same.any():
            break
        a, b = prints[step:][same], prints[:-step][same]
        ok = _linked(a ^ b)
        one.append(a[ok])
        two.append(b[ok])
    for start, size in zip(starts, sizes):
        if size > SMALL or side[start] != 2:
            block, rows = side[start : start + size], fp[start : start + size]
            a, b = _stars(rows, None) if block[0] == 2 else _stars(rows[block == 0], rows[block == 1])
            one.append(a)
            two.append(b)
    none = np.empty(0, np.uint64)
    return (np.concatenate(one), np.concatenate(two)) if one else (none, none)


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """prints: distinct fp. Returns a, b: enough links that fingerprints are connected exactly when a chain of near ones joins them."""
    postings = _postings(prints)
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = postings.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # side 2: both of a pair are in this block; 0 and 1: they are in different ones.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct((F.least(j, "own") * F.col("blocks") + F.greatest(j, "own")).alias("pair"), F.when(j == F.col("own"), 2).when(F.col("own") < j, 0).otherwise(1).alias("side")),
    )
    dealt = met.withColumn("own", own).select("key", "fp", F.inline(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            differs = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut_at = int(differs[-1]) + 1 if len(differs) else 0
            rest = [x[cut_at:] for x in now]
            if cut_at:
                yield made([x[:cut_at] for x in now])
        if rest is not None and len(rest[0]):
            yield made(rest)

    def made(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, pair, side, fp = columns
        a, b = _links_of(key, side, pair, fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    grouped = dealt.select("key", "pair", "side", "fp").repartition("key", "pair").sortWithinPartitions("key", "pair")
    return grouped.mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_classes: int = components.BROADCAST_KEYS, hot_rows: int = components.HOT_ROWS) -> DataFrame:
    """Returns id_col, text_hash, fp, root (the component's smallest fingerprint, as a signed long) and component_id (the smallest id reachable over links) for each row."""
    rows = cut(fingerprints(docs, id_col, text_col))
    prints = rows.groupBy("fp").agg(F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_n"))
    joined = components.roots(links(prints.select("fp")), broadcast_classes, hot_rows)
    member = joined.select(F.col("node").alias("fp"), "root").union(joined.select(F.col("root").alias("fp"), "root").distinct())
    known = cut(member.join(prints, "fp").select("fp", "root", "_least"))
    least = cut(known.groupBy("root").agg(F.min("_least").alias("_component"), F.count(F.lit(1)).alias("_n")))
    linked = components.spread_join(known.select("fp", "root"), least, "root", broadcast_classes, hot_rows).drop("_n")
    alone = F.col("root").isNull()
    named = prints.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(alone, F.col("_least")).otherwise(F.col("_component")).alias("component_id"), "_n")
    return components.spread_join(rows, cut(named), "fp", broadcast_classes, hot_rows).select(id_col, "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, fingerprint (16 hexadecimal digits), component_id for each row."""
    return classes(docs, id_col, text_col).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all columns of ``docs``: the smallest id, of rows that share it the smallest text hash, of identical rows one.

    Rows without an id come last in their component.
    """
    found = classes(docs, id_col, text_col)
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col), F.lit(0)).alias("id"), "text_hash")
    kept = found.groupBy("root").agg(F.min(order).alias("keep")).select("keep.*")
    raw = F.col(id_col).cast("long")
    keyed = docs.select(F.struct("*").alias("row"), raw.isNull().alias("no_id"), F.coalesce(raw, F.lit(0)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    key = ["no_id", "id", "text_hash"]
    return keyed.dropDuplicates(key).join(kept, key).select("row.*")  # repeated rows are dropped before the shuffle
