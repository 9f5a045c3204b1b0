"""Ranks and running sums in a global order, without a task that sees all rows.

Rows are cut into slices of the order, whose edges are approximate percentiles
or the leading bits of a hash. Counts per slice give what lies before it; only
inside a slice are rows ordered. What the driver holds is one number per slice
and class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 1024
HASH_BITS = 12


def reached(value: Column, edges: list, strict: bool = False) -> Column:
    """How many of the rising edges a value reaches, by halving steps."""
    steps, k = [], 1
    while k <= len(edges):
        steps.insert(0, k)
        k *= 2
    array = F.array(*[F.lit(e) for e in edges])
    less = (lambda a: a < value) if strict else (lambda a: a <= value)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda i, s: F.when((i + s <= len(edges)) & less(F.element_at(array, F.least(i + s, F.lit(len(edges))))), i + s).otherwise(i),
    )


def number(df: DataFrame, column: str) -> Column:
    """A numeric or time column as a number of the same order."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.unix_date(column) if kind == "date" else F.col(column)


def range_slice(df: DataFrame, column: str, slices: int = SLICES) -> Column:
    """The slice of a numeric or time column that a row falls into."""
    value = number(df, column)
    found = df.agg(F.percentile_approx(value, [k / slices for k in range(1, slices)], 10 * slices)).first()[0]
    edges = sorted(set(found or []))
    return reached(value, edges, strict=True) if edges else F.lit(0)


def hash_slice(hashed: Column) -> Column:
    """The slice that a 64-bit hash falls into."""
    return F.shiftright(hashed, 64 - HASH_BITS).cast("int")


def rows_at(df: DataFrame, order: list[str], ranks: dict, by: str | None = None) -> dict:
    """Values of the order columns in the rows of given ranks, from 1, per class.

    ``df`` has its slice in __s. ``ranks`` maps a class of ``by`` and its size
    to the ranks wanted; ranks outside 1..size are left out. The result maps
    (class, rank) to values.
    """
    keys = [by] if by else []
    counts: dict = {}
    for r in df.groupBy(*keys, "__s").count().collect():
        counts.setdefault(r[by] if by else None, []).append((r["__s"], r["count"]))
    wanted: dict[tuple, list[tuple[int, int]]] = {}
    for c, found in counts.items():
        size = sum(n for _, n in found)
        for rank in ranks(c, size):
            before = 0
            for s, n in sorted(found):
                if before < rank <= before + n:
                    wanted.setdefault((c, s), []).append((rank, rank - before))
                before += n
    if not wanted:
        return {}
    here = lambda c, s: (F.col(by).eqNullSafe(F.lit(c)) if by else F.lit(True)) & (F.col("__s") == s)
    inside = hit = F.lit(False)
    for (c, s), places in wanted.items():
        inside = inside | here(c, s)
        hit = hit | (here(c, s) & F.col("__k").isin([k for _, k in places]))
    w = Window.partitionBy(*keys, "__s").orderBy(*order)
    out = {}
    for r in df.filter(inside).withColumn("__k", F.row_number().over(w)).filter(hit).select(*keys, "__s", "__k", *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)]).collect():
        c = r[by] if by else None
        for rank, k in wanted[c, r["__s"]]:
            if k == r["__k"]:
                out[c, rank] = tuple(r[f"__o{i}"] for i in range(len(order)))
    return out


def sizes(df: DataFrame, by: str) -> dict:
    """Rows of each class."""
    return {r[by]: r["count"] for r in df.groupBy(by).count().collect()}


def up_to(df: DataFrame, order: list[str], values: tuple) -> Column:
    """Whether a row stands at or before the row of these values."""
    kinds = dict(df.dtypes)
    last = F.struct(*[F.lit(v).cast(kinds[o]).alias(o) for o, v in zip(order, values, strict=True)])
    return F.struct(*order) <= last


def running(df: DataFrame, levels: DataFrame, column: str, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """``levels`` with what each sum comes to before a row, ``<sum>_before``, and in all, ``<sum>_all``.

    ``levels`` has one row per (``by`` and) value of ``column``, and columns
    ``sums``; ``df`` is any table with the same values, from which the slices
    are cut. Rows are taken by rising values, nulls first.
    """
    by = by or []
    sliced = levels.withColumn("__s", F.coalesce(range_slice(df, column), F.lit(-1)))
    per = sliced.groupBy(*by, "__s").agg(*[F.sum(s).alias(s) for s in sums])
    # One row per slice and group: these windows are small at any size.
    w, whole = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    offset = per.select(*by, "__s", *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"__{s}") for s in sums], *[F.sum(s).over(whole).alias(f"{s}_all") for s in sums])
    within = Window.partitionBy(*by, "__s").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    out = sliced.select("*", *[F.coalesce(F.sum(s).over(within), F.lit(0)).alias(f"{s}_before") for s in sums]).join(F.broadcast(offset), [*by, "__s"])
    return out.withColumns({f"{s}_before": F.col(f"{s}_before") + F.col(f"__{s}") for s in sums}).drop("__s", *[f"__{s}" for s in sums])
