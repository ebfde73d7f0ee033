"""Operator 12: compression of vectors to codes, by Lloyd's algorithm with Elkan's bounds.

Components become integers floor(256 x), and a vector is cut into ``PARTS``
equal parts. Each part position has a codebook of ``ENTRIES`` entries, at first
the parts of the vectors with the smallest ids. A round assigns each part to its
nearest entry and moves entries to the floored means of their parts.

A row keeps, from round to round in a written table, its codes, for each part an
upper bound of the distance to its entry, and a lower bound for every entry of
the part's codebook, one byte each, rounded down to a 255th of the codebook's
first extent. When entries have moved, upper bounds grow and lower bounds shrink
by their movement. An entry is left out without a look at its components only if
its lower bound, or half its distance to the part's entry, is strictly above the
upper bound; the distances of the others are integers, so equal ones are seen
and go to the lower index. Sums of parts are made in each task, one row for each
entry, so a round shuffles and collects a bounded table. The last round's bounds
serve only the final codes, which are made from the table before it, so they are
not written.

Cases: rows with a vector that is null, or holds null or non-finite components,
take no part, nor do vectors of another length than most have (of equally
frequent lengths the smallest; lengths that ``PARTS`` doesn't divide, and empty
vectors, are left out). Repeated rows count each; of vectors that share an id
the smallest begins an entry; rows with a null id are coded and averaged, and
begin none. Fewer ids than entries give shorter codebooks, an empty table no row.
Other columns are left out. Where squared distances could leave 64 bits the query
fails with an OverflowError instead of a wrong code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.components import BROADCAST_KEYS, spread_join
from veritrail.llm.lineage import written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
LEVELS = 255
#: Bounds are rounded outward by more than doubles and 32-bit floats can be off.
OUT, IN = 1 + 1e-6, 1 - 1e-6

Codebooks = np.ndarray  # parts x entries x width, integers


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """Rows that take part as (id, label, v ARRAY<LONG>), and the length of their vectors (0 if there are none)."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    most = F.array_max(F.transform("v", F.abs))
    sized = rows.withColumn("size", F.size("v")).where((F.col("size") > 0) & (F.col("size") % parts == 0))
    common = sized.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max(most).alias("most")).orderBy(F.desc("n"), "size").first()
    if common is None:
        return rows, 0
    reach = int(common["most"] * SCALE) + 1
    if (2 * reach) ** 2 * common["size"] >= 2**62:
        raise OverflowError("squared distances could leave 64 bits")
    return sized.where(F.col("size") == common["size"]).select("id", "label", whole.alias("v")), common["size"]


def first_entries(rows: DataFrame, dim: int, parts: int, entries: int) -> Codebooks:
    """Parts of the vectors with the smallest ids."""
    ids = rows.where("id IS NOT NULL").select("id").distinct().orderBy("id").limit(entries)
    chosen = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    return np.array([r["v"] for r in chosen], np.int64).reshape(len(chosen), parts, dim // parts).transpose(1, 0, 2)


def between(entries: np.ndarray) -> np.ndarray:
    """Distances of a codebook's entries from each other, rounded down."""
    apart = entries[:, None, :] - entries[None, :, :]
    return np.sqrt((apart * apart).sum(axis=2).astype(np.float64)) * IN


def units(codebooks: Codebooks) -> np.ndarray:
    """What one step of a lower bound stands for, by part."""
    extents = np.array([between(c).max(initial=0.0) for c in codebooks])
    return np.where(extents > 0, extents / LEVELS, 1.0)


def lowered(distances: np.ndarray, unit: float) -> np.ndarray:
    """Lower bounds as bytes."""
    return np.minimum(distances * (IN / unit), LEVELS).astype(np.uint8)


def assign(x: np.ndarray, entries: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First codes, upper and lower bounds of one part, from all distances."""
    squared = np.zeros((len(x), len(entries)), np.int64)
    for place in range(x.shape[1]):
        apart = x[:, place, None] - entries[None, :, place]
        squared += apart * apart
    code = squared.argmin(axis=1)
    distances = np.sqrt(squared.astype(np.float64))
    return code, distances[np.arange(len(x)), code] * OUT, lowered(distances, unit)


def reassign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, entries: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds of one part after its entries moved, and how many distances were computed."""
    moved = entries - before
    shift = np.sqrt((moved * moved).sum(axis=1).astype(np.float64)) * OUT
    upper = (upper + shift[code]) * OUT
    bound = np.maximum(lower * (unit * IN) - shift[None, :], 0.0)
    half = 0.5 * between(entries)
    every = np.arange(len(x))

    open_ = (bound <= upper[:, None]) & (half[code] <= upper[:, None])
    open_[every, code] = False
    rows = np.flatnonzero(open_.any(axis=1))
    apart = x[rows] - entries[code[rows]]
    own = (apart * apart).sum(axis=1)
    tight = np.sqrt(own.astype(np.float64))
    upper[rows] = tight * OUT
    bound[rows, code[rows]] = tight * IN
    at, entry = np.nonzero(open_[rows] & (bound[rows] <= upper[rows, None]) & (half[code[rows]] <= upper[rows, None]))
    apart = x[rows[at]] - entries[entry]
    squared = np.full((len(rows), len(entries)), np.iinfo(np.int64).max)
    squared[np.arange(len(rows)), code[rows]] = own
    squared[at, entry] = (apart * apart).sum(axis=1)
    bound[rows[at], entry] = np.sqrt(squared[at, entry].astype(np.float64)) * IN
    code = code.copy()
    code[rows] = squared.argmin(axis=1)
    upper[rows] = np.sqrt(squared[np.arange(len(rows)), code[rows]].astype(np.float64)) * OUT
    return code, upper, lowered(bound, unit), len(rows) + len(at)


class State:
    """Codes and bounds of a batch of rows: code (rows x parts), upper (rows x parts), lower (rows x parts x entries)."""

    def __init__(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        self.x, self.code, self.upper, self.lower = x, code, upper, lower

    @classmethod
    def first(cls, x: np.ndarray, codebooks: Codebooks, unit: np.ndarray) -> State:
        code, upper, lower = zip(*(assign(x[:, p], codebooks[p], unit[p]) for p in range(len(codebooks))))
        return cls(x, np.stack(code, 1), np.stack(upper, 1), np.stack(lower, 1))

    def next(self, before: Codebooks, codebooks: Codebooks, unit: np.ndarray) -> State:
        made = [reassign(self.x[:, p], self.code[:, p], self.upper[:, p], self.lower[:, p], before[p], codebooks[p], unit[p])[:3] for p in range(len(codebooks))]
        code, upper, lower = zip(*made)
        return State(self.x, np.stack(code, 1), np.stack(upper, 1), np.stack(lower, 1))

    def errors(self, codebooks: Codebooks) -> np.ndarray:
        apart = self.x - codebooks[np.arange(len(codebooks))[None, :], self.code]
        return (apart * apart).sum(axis=(1, 2))


def _x(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def _bytes(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).reshape(len(rows), -1).view(np.uint8)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _from_bytes(column: pa.Array, dtype: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _state(batch: pa.RecordBatch, parts: int, entries: int) -> State:
    column = batch.column
    return State(_x(column("v"), parts), _from_bytes(column("code"), "u1", parts).astype(np.int64), _from_bytes(column("upper"), "<f4", parts).astype(np.float64) * OUT, _from_bytes(column("lower"), "u1", parts, entries))


def _sums(rows: DataFrame, states, codebooks: Codebooks) -> Codebooks:  # noqa: ANN001
    """Entries moved to the floored means of their parts; entries without parts stay. ``states`` makes State objects of batches."""
    parts, entries, width = codebooks.shape
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            state = states(batch)
            for p in range(parts):
                order = np.argsort(state.code[:, p], kind="stable")
                found, at, n = np.unique(state.code[order, p], return_index=True, return_counts=True)
                count[p, found] += n
                if len(found):
                    total[p, found] += np.add.reduceat(state.x[order, p], at, axis=0)
        part, entry = np.nonzero(count)
        columns = [part.astype(np.int32), entry.astype(np.int32), count[part, entry], *(total[part, entry, i] for i in range(width))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "n", *names])

    partial = rows.mapInArrow(run, f"part int, entry int, n long, {', '.join(f'{c} long' for c in names)}")
    summed = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in names]).collect()
    moved = codebooks.copy()
    for r in summed:
        moved[r["part"], r["entry"]] = [int(r[c]) // r["n"] for c in names]
    return moved


def digest(codebooks: Codebooks) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Returns id_col, code, error, label_error, codebooks_sha256 for each row that takes part."""
    rows, dim = kept(vectors, id_col, vector_col, label_col, parts)
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    books = [first_entries(rows, dim, parts, entries)] if dim else []
    if not books or not books[0].size:
        return vectors.sparkSession.createDataFrame([], f"{id_col} {id_type}, code string, error long, label_error long, codebooks_sha256 string")
    unit, size = units(books[0]), books[0].shape[1]
    first = books[0]

    def begin(batch: pa.RecordBatch) -> State:
        return State.first(_x(batch.column("v"), parts), first, unit)

    def follow(*moves: tuple[Codebooks, Codebooks]):  # noqa: ANN202
        def run(batch: pa.RecordBatch) -> State:
            state = _state(batch, parts, size)
            for before, after in moves:
                state = state.next(before, after, unit)
            return state

        return run

    def stored(source: DataFrame, states) -> DataFrame:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = states(batch)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"), _bytes(s.code.astype(np.uint8)), _bytes(s.upper.astype("<f4")), _bytes(s.lower)], names=["id", "label", "v", "code", "upper", "lower"])

        return written(source.mapInArrow(run, f"id {id_type}, label {label_type}, v array<long>, code binary, upper binary, lower binary"), "bounds")

    table = stored(rows, begin)
    books.append(_sums(table, follow(), first))
    for number in range(1, rounds):
        if number > 1:
            table = stored(table, follow((books[number - 2], books[number - 1])))
        books.append(_sums(table, follow((books[number - 1], books[number])), books[number]))
    moves = list(zip(books, books[1:]))[max(0, rounds - 2) :]
    last = books[-1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = follow(*moves)
        for batch in batches:
            s = states(batch)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in s.code.astype(np.uint8)], pa.string()), pa.array(s.errors(last))], names=["id", "label", "code", "error"])

    codes = written(table.mapInArrow(coded, f"id {id_type}, label {label_type}, code string, error long"), "codes")
    # Nulls are one group, so labels are keyed by a text that marks them.
    key = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    keyed = codes.withColumn("_label", key)
    sums = written(keyed.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "labels")
    joined = spread_join(keyed, sums, "_label", broadcast_keys)
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(last)).alias("codebooks_sha256"))


def duckdb_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    def round_(n: int) -> str:
        return f"""d{n} AS MATERIALIZED (SELECT x.row, x.part, c.entry, list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{n} AS c USING (part)),
a{n} AS MATERIALIZED (SELECT * FROM d{n} QUALIFY row_number() OVER (PARTITION BY row, part ORDER BY d, entry) = 1),
s{n} AS (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS place FROM a{n} JOIN x USING (row, part)),
m{n} AS (SELECT part, entry, list(s ORDER BY place) AS x FROM (SELECT part, entry, place, CAST(floor(sum(v)::DOUBLE / count(*)) AS BIGINT) AS s FROM s{n} GROUP BY ALL) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{n} AS c LEFT JOIN m{n} AS m USING (part, entry))"""

    made = ",\n".join(round_(n) for n in range(rounds + 1))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda y: CAST(floor({SCALE} * y::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT row, vec_id, label, part, e[part * len(e) // {parts} + 1:(part + 1) * len(e) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, CAST(dense_rank() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS entry, x FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})),
{made},
r AS (SELECT v.vec_id, v.label, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} JOIN v USING (row) GROUP BY row, v.vec_id, v.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM r"""
