"""Small results as text and pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordering


def markdown_lines(table: DataFrame) -> DataFrame:
    """A small result as lines of a markdown table, in order of line."""
    spark = table.sparkSession
    head = [(0, "| " + " | ".join(table.columns) + " |"), (1, "|" + "---|" * len(table.columns))]
    cells = [F.coalesce(F.format_number(c, 4) if t == "double" else F.col(c).cast("string"), F.lit("")) for c, t in table.dtypes]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = table.select((F.monotonically_increasing_id() + 2).alias("line"), line.alias("text"))
    return spark.createDataFrame(head, "line long, text string").unionByName(body)


def save_markdown(table: DataFrame, path: str) -> None:
    """Write the markdown lines as one text file; for small results."""
    markdown_lines(table).orderBy("line").select("text").coalesce(1).write.mode("overwrite").text(path)


def thinned(points: DataFrame, x: str, most: int = 1000) -> DataFrame:
    """About ``most`` rows, spread evenly over the order of ``x``, both ends among them."""
    sliced = points.withColumn("__s", F.coalesce(ordering.range_slice(points, x, most), F.lit(-1)))
    row = F.struct(*points.columns)
    ends = points.agg(F.max_by(row, x).alias("r"))
    return sliced.groupBy("__s").agg(F.min_by(row, x).alias("r")).select("r").unionByName(ends).filter("r is not null").select("r.*").distinct()


def save_chart(points: DataFrame, x: str, y: str, path: str) -> None:
    """Draw a curve, thinned to about a thousand points; needs matplotlib."""
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot

    rows = thinned(points, x).orderBy(x).collect()
    pyplot.figure()
    pyplot.plot([r[x] for r in rows], [r[y] for r in rows])
    pyplot.xlabel(x)
    pyplot.ylabel(y)
    pyplot.savefig(path)
    pyplot.close()
