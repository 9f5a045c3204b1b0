"""Compare registered queries with their SQL: python tests/oracles.py [sf_dir] [name...]."""

import glob
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if Path(p).is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v if isinstance(v, (int, str)) else (float(v) if hasattr(v, "as_tuple") else str(v))


def compare(spark, con, sf_dir, query, sql):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    order = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    if sorted(names) != order:
        return f"columns {order} and {sorted(names)}"
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} and {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ: {bad[:2]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "10g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, names = connect(sf), entry.oracle_sql(), sys.argv[2:]
    for name, query in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            if name in sqls:
                said = compare(spark, con, sf, query, sqls[name]) or "equal"
            else:
                said = f"rows only: {query(spark, sf).count()}"
        except Exception:
            said = "ERROR " + " ".join(traceback.format_exc().split("\n")[-4:])[:700]
        print(f"{name} {time.time() - began:.1f}s {said[:900]}", flush=True)
