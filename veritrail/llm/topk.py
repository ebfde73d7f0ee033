"""Operator 8: exact top-k search by a three-phase uniform threshold.

The score is an integer inner product, cut into ``SLICES`` slices of dimensions.
Each slice of each block of candidates is a local score list, and a task sees the
parts of one slice alone.

1. Every local list gives its k best parts per query; of these the k best of each
   slice are gathered, SLICES * k candidates a query at most. Scores have signs,
   so a part that is not known cannot count as 0: the totals of the gathered ones
   are looked up. The k-th best total of a query is its cutoff, as at least k
   candidates reach it.
2. The cutoff goes out with the queries. A candidate that reaches it has at
   least one part of a SLICES-th of it, whatever the signs (else the slices sum
   to less), so the lists send exactly the parts that reach this share. Where all
   parts of a candidate were sent, its total is their sum; else the parts not sent
   are below the share, which bounds it.
3. Candidates whose bound reaches the cutoff, and the k-th best known total of
   their block, are looked up: full vectors are read for these entries alone. The
   k best of each block are sent on and ranked.

Two slices make the share as large as it can be with several lists, so the fewest
entries are sent.

Queries meet candidates in blocks: a block of queries is sent to each block of
candidates, which is the stated query set against all rows, not a cross join of
rows. A task holds a slice of one block of each and a tile of parts. Blocks hold
a fixed number of rows (``CANDIDATES``, ``QUERIES``), so more rows make more
blocks, and copies of one vector, or vectors that share an id, fill blocks like
any others. The best of a query are chosen by row_number, which Spark applies
before the shuffle as well, so no row holds a list that grows with the table.

Cases: vectors that are null, or hold null or non-finite components, take no
part, nor do rows with a null id; rows repeated with the same id and vector
count once; a query is never its own answer, by id; vectors only meet vectors
of the same length, and empty ones score 0; ties go to the smaller id; fewer
than k candidates give fewer rows; other columns are left out. Vectors that share
an id all take part: their answers are ranked together as those of the id. Scaled
components and scores are 64-bit integers; where a sum could leave these, the
query fails with an OverflowError instead of a wrong order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.lineage import cut

SCALE = 256
SLICES = 2
CANDIDATES = 8192
QUERIES = 256
#: Below any cutoff that 64-bit sums can reach.
LOWEST = -(2**62)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Distinct (id, dim, v ARRAY<LONG>, vh) of the rows that take part; v is floor(256 * x), vh tells vectors of one id apart."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.col(id_col).isNotNull())
    made = rows.select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("v")).distinct()
    return made.withColumn("vh", F.xxhash64("v"))


def _blocks(rows: DataFrame, blocks: int, name: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Deals rows of each dim into ``blocks`` blocks and packs each: dim, name, name_ids, name_vhs, name_vs, and ``extra`` lists."""
    block = F.pmod(F.xxhash64("id", "vh"), F.lit(blocks)).cast("int")
    packed = rows.withColumn(name, block).groupBy("dim", name).agg(F.collect_list(F.struct("id", "vh", "v", *extra)).alias("rows"))
    return packed.select("dim", name, F.col("rows.id").alias(f"{name}_ids"), F.col("rows.vh").alias(f"{name}_vhs"), F.flatten(F.col("rows.v")).alias(f"{name}_vs"), *[F.col(f"rows.{x}").alias(f"{name}_{x}") for x in extra])


def _sliced(blocks: DataFrame, name: str) -> DataFrame:
    """One row per slice of a block, which holds the components of that slice alone."""
    low, high = F.floor(F.col("slice") * F.col("dim") / SLICES).cast("int"), F.floor((F.col("slice") + 1) * F.col("dim") / SLICES).cast("int")
    rows = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    at = F.transform(F.sequence(F.lit(0), F.size(f"{name}_ids") - 1), lambda i: F.slice(f"{name}_vs", i * F.col("dim") + low + 1, high - low))
    return rows.withColumn(f"{name}_vs", F.flatten(at)).withColumn("width", high - low)


def _pairs(asked: DataFrame, lists: DataFrame, c_blocks: int) -> DataFrame:
    """Every block of queries with every block of candidates, slice by slice.

    The copies of the queries are shuffled: their number grows with both tables,
    but Spark takes them for as small as the queries and would send them through
    the driver.
    """
    to_each = F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))
    return asked.withColumn("c", to_each).drop("width").hint("merge").join(lists, ["dim", "slice", "c"])


def _list(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products a @ b.T; in doubles while every partial sum stays below 2**53."""
    if not a.shape[1] or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    top = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if top * SLICES >= 2**62:
        raise OverflowError("scores could leave 64 bits")
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if top < 2**53 else a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, the smaller id first among equal scores."""
    if len(scores) > k:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]


def _columns(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)], names=names)


def local_best(pairs: DataFrame, k: int) -> DataFrame:
    """Phase 1: the k best parts of every local list: query_id, q_vh, slice, vec_id, c_vh, part."""
    names = ["query_id", "q_vh", "slice", "vec_id", "c_vh", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width, number = batch.column("width")[r].as_py(), batch.column("slice")[r].as_py()
                query_ids, ids, q_vhs, c_vhs = (_list(batch, n, r) for n in ("q_ids", "c_ids", "q_vhs", "c_vhs"))
                parts = _exact(_list(batch, "q_vs", r).reshape(len(query_ids), width), _list(batch, "c_vs", r).reshape(len(ids), width))
                found = []
                for q, own in enumerate(query_ids):
                    open_ = np.flatnonzero(ids != own)
                    top = open_[_best(parts[q][open_], ids[open_], k)]
                    same = np.full(len(top), 1)
                    found.append((same * own, same * q_vhs[q], same * number, ids[top], c_vhs[top], parts[q][top]))
                if found:
                    yield _columns(found, names)

    return pairs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def sent(pairs: DataFrame) -> DataFrame:
    """Phase 2: what every local list sends: dim, q, c, slice, n and for the parts at or above a SLICES-th of the cutoff their places (query * candidates + candidate) and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width = batch.column("width")[r].as_py()
                query_ids, ids, cuts = _list(batch, "q_ids", r), _list(batch, "c_ids", r), _list(batch, "q_cut", r)
                parts = _exact(_list(batch, "q_vs", r).reshape(len(query_ids), width), _list(batch, "c_vs", r).reshape(len(ids), width))
                places = np.flatnonzero((parts >= share(cuts)[:, None]) & (query_ids[:, None] != ids[None, :]))
                keys = [batch.column(n).slice(r, 1) for n in ("dim", "q", "c", "slice")]
                values = parts.ravel()[places]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([len(places)], pa.int64()), pa.array([places], pa.list_(pa.int64())), pa.array([values], pa.list_(pa.int64()))], names=["dim", "q", "c", "slice", "n", "places", "parts"])

    return pairs.mapInArrow(run, "dim int, q int, c int, slice int, n long, places array<long>, parts array<long>")


def share(cuts: np.ndarray) -> np.ndarray:
    """The least part that a candidate must have in some slice to reach the cutoff."""
    return -(-cuts // SLICES)


def open_entries(places: list[np.ndarray], parts: list[np.ndarray], cuts: np.ndarray, n: int, k: int) -> np.ndarray:
    """Phase 2, where the lists of two blocks meet: places whose bound reaches the cutoff and the k-th best known total of the query in this block."""
    place, row = np.unique(np.concatenate(places), return_inverse=True)
    total, lists = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    np.add.at(total, row, np.concatenate(parts))
    np.add.at(lists, row, 1)
    query = place // n
    known = lists == SLICES
    bound = total + (SLICES - lists) * (share(cuts)[query] - 1)
    floor = cuts.copy()
    order = np.lexsort((-total[known], query[known]))
    of, best = query[known][order], total[known][order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    kth = rank == k - 1
    floor[of[kth]] = np.maximum(floor[of[kth]], best[kth])
    return place[bound >= floor[query]]


def resolved(pairs: DataFrame, k: int) -> DataFrame:
    """Phase 3: totals of the open entries, the k best of each block that reach the cutoff: query_id, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                query_ids, ids, cuts = _list(batch, "q_ids", r), _list(batch, "c_ids", r), _list(batch, "q_cut", r)
                lists = batch.column("lists")[r].values
                every = [(np.asarray(x["places"].values), np.asarray(x["parts"].values)) for x in lists]
                place = open_entries([p for p, _ in every], [v for _, v in every], cuts, len(ids), k)
                queries, block = _list(batch, "q_vs", r).reshape(len(query_ids), dim), _list(batch, "c_vs", r).reshape(len(ids), dim)
                edges, found = np.searchsorted(place, np.arange(len(query_ids) + 1) * len(ids)), []
                for q in np.flatnonzero(np.diff(edges)):
                    at = place[edges[q] : edges[q + 1]] - q * len(ids)
                    total = block[at] @ queries[q]
                    at, total = at[total >= cuts[q]], total[total >= cuts[q]]
                    top = _best(total, ids[at], k)
                    found.append((np.full(len(top), query_ids[q]), ids[at[top]], total[top]))
                if found:
                    yield _columns(found, ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def _first(scores: DataFrame, k: int, by: list[str], score: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """Returns query_id, rank, vec_id, score: the k best candidates of each row for which ``is_query`` (over the column ``id``) holds."""
    rows = cut(quantised(vectors, id_col, vector_col))  # read by every phase
    asked = rows.where(is_query)
    n, m = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    c_blocks, q_blocks = max(1, -(-n // candidates)), max(1, -(-m // queries))
    blocks = cut(_blocks(rows, c_blocks, "c"))
    lists = _sliced(blocks, "c")

    first = local_best(_pairs(_sliced(_blocks(asked, q_blocks, "q"), "q"), lists, c_blocks), k)
    gathered = _first(first, k, ["query_id", "slice"], "part").select("query_id", "q_vh", "vec_id", "c_vh").distinct()
    of = lambda name, row, hash_: rows.select(F.col("id").alias(row), F.col("vh").alias(hash_), F.col("v").alias(name))
    looked_up = gathered.join(of("qv", "query_id", "q_vh"), ["query_id", "q_vh"]).join(of("cv", "vec_id", "c_vh"), ["vec_id", "c_vh"])
    dot = F.aggregate(F.zip_with("qv", "cv", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x)
    cutoffs = _first(looked_up.select("query_id", "vec_id", dot.alias("total")), k, ["query_id"], "total").where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("total").alias("cut"))
    # With fewer than k candidates gathered everything may be an answer.
    aimed = asked.join(cutoffs, "id", "left").withColumn("cut", F.coalesce("cut", F.lit(LOWEST)))

    asked_blocks = cut(_blocks(aimed, q_blocks, "q", ("cut",)))
    parts = sent(_pairs(_sliced(asked_blocks, "q"), lists, c_blocks))
    met = parts.where("n > 0").groupBy("dim", "q", "c").agg(F.collect_list(F.struct("places", "parts")).alias("lists"))
    final = resolved(met.join(asked_blocks, ["dim", "q"]).join(blocks, ["dim", "c"]), k)
    return _first(final, k, ["query_id"], "score").select("query_id", "rank", "vec_id", "score")


def duckdb_sql(k: int = 5, every: int = 50) -> str:
    return f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= {k}"""
