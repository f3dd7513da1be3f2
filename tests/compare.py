"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    """One comparable form for the values of both engines."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(made, key=repr)


def compare(spark, con, sf_dir: str, name: str, query) -> str:
    """``ok`` or what differs."""
    df = query.run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return f"rows only ({len(got[1])})"
    cur = con.execute(query.sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        return f"rows {len(got[1])} / {len(want[1])}: {sorted(a - b)[:2]} / {sorted(b - a)[:2]}"
    for g, w in zip(got[1], want[1]):
        if repr(g) != repr(w):
            return f"{got[0]}: {g} / {w}"
    return f"ok ({len(got[1])})"


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from tiergraph.plans.queries import REGISTRY
    from tiergraph.session import build_session

    folder = sys.argv[1]
    names = sys.argv[2:] or list(REGISTRY)
    session = build_session(master="local[8]", shuffle_partitions=8,
                            extra={"spark.ui.enabled": "false",
                                   "spark.ui.showConsoleProgress": "false",
                                   "spark.driver.memory": "16g"})
    session.sparkContext.setLogLevel("ERROR")
    base = database(folder)
    for n in names:
        t0 = time.time()
        try:
            outcome = compare(session, base, folder, n, REGISTRY[n])
        except Exception as error:  # noqa: BLE001
            outcome = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{n:24s} {time.time() - t0:6.1f}s {outcome}", flush=True)
