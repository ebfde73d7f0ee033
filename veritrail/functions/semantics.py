"""Column helpers whose exact semantics every operator relies on."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go toward +infinity, unlike ``round`` (-2.5 becomes -2)."""
    k = float(10**digits)
    return F.floor(x * F.lit(k) + F.lit(0.5)) / F.lit(k)


def utf16_len(x: Column) -> Column:
    """Length in UTF-16 code units: two for a character outside the basic plane."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("long")


def est_tokens(x: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up; 0 for an empty text, null for null."""
    return F.ceil(utf16_len(x) / F.lit(4)).cast("long")


def norm_text(x: Column) -> Column:
    """Lower case; every run of other than a-z and 0-9 is one space; no outer spaces."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def norm_path(x: Column) -> Column:
    """Lower case with forward slashes and no leading ``./``."""
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"\\", "/")), r"^\./", "")


def unicode_trim(x: Column) -> Column:
    """Strips white space of any script, where ``trim`` strips only spaces."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def ratio(num: Column, den: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_metric(num: Column, den: Column, observable: Column | None = None) -> Column:
    """STRUCT(availability, numerator, denominator, rate): an empty denominator is not-applicable, what cannot be observed is unavailable, and neither is 0."""
    seen = F.lit(True) if observable is None else observable
    ok = seen & (den > 0)
    return F.struct(
        F.when(~seen, "unavailable").when(den == 0, "not-applicable").otherwise("available").alias("availability"),
        F.when(ok, num).alias("numerator"),
        F.when(ok, den).alias("denominator"),
        F.when(ok, ratio(num, den)).alias("rate"),
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first row of each key by ``order`` (the last one with ``last``).

    One aggregation with map-side combine, so a hot key never meets in a sort.
    """
    cols = df.columns
    pick = F.max_by if last else F.min_by
    rest = [c for c in cols if c not in keys]
    got = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return got.select(*[F.col(k) if k in keys else F.col("_row")[k].alias(k) for k in cols])


def dense_counts(df: DataFrame, key: str, levels: list[str], out: str = "n") -> DataFrame:
    """Counts for a closed vocabulary: every level has a row, 0 where none occurs; other values are left out."""
    counts = df.agg(*[F.count_if(F.col(key) == F.lit(v)).alias(f"c{i}") for i, v in enumerate(levels)])
    pairs = F.array(*[F.struct(F.lit(v).alias(key), F.col(f"c{i}").alias(out)) for i, v in enumerate(levels)])
    return counts.select(F.inline(pairs))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def all_of(predicates: list[Column]) -> Column:
    """Conjunction; an empty list is true."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def positions(order: list[Column]) -> Column:
    """Position in one total order: 1 for the first, no ties."""
    return F.row_number().over(W.orderBy(*order))
