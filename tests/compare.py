"""Run queries in Spark and their SQL in DuckDB on one data folder and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parents[1]))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def rows_of(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[bool, str]:  # noqa: ANN001
    t = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t, t0 = time.time(), t
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    same = got == want and sorted(names) == sorted(df.columns)
    more = "" if same else f" only Spark {list((got - want).items())[:3]} only SQL {list((want - got).items())[:3]} {sorted(names)} {sorted(df.columns)}"
    return same, f"rows {sum(got.values())}/{sum(want.values())} spark {t - t0:.1f}s sql {time.time() - t:.1f}s{more}"


def main() -> None:
    import __spark_entry__ as entry

    from tremorline.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            if name in sqls:
                ok, what = compare(spark, con, query, sqls[name], sf_dir)
                print("OK  " if ok else "DIFF", name, what, flush=True)
            else:
                t = time.time()
                print("----", name, f"rows {query(spark, sf_dir).count()} spark {time.time() - t:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            print("FAIL", name, str(e)[:1500], flush=True)


if __name__ == "__main__":
    main()
