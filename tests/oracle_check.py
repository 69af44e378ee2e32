"""Compare registered queries with their DuckDB statements.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )


def compare(df, con, sql):
    """``None`` if equal, else a short description of the difference."""
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = canonical(want_columns, cursor.fetchall())
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:3] if len(got) < 200000 else "?"
    missing = [r for r in want if r not in set(got)][:3] if len(want) < 200000 else "?"
    return f"rows {len(got)} / {len(want)}; only spark {extra}; only duckdb {missing}"


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    con.execute("SET TimeZone='UTC'")
    bad = 0
    for name, query in entry.queries().items():
        if argv[1:] and not any(a in name for a in argv[1:]):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sql:
                diff = compare(df, con, sql[name])
                rows = "" if diff else df.count()
            else:
                diff, rows = None, f"{df.count()} rows only"
        except Exception as error:  # report and go on with the next query
            diff, rows = str(error)[:1500], ""
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {rows} {time.time() - start:.1f}s {diff or ''}",
              flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
