"""Run registered queries next to their check SQL: python tests/compare.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return round(float(value), 9) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when both sides agree, else the first difference."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}\n  spark {got[1][:2]}\n  duck  {want[1][:2]}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{got[0]}\n  spark {a}\n  duck  {b}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from lumenary.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), duck(sf_dir)
    checks, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in checks:
                problem = compare(spark, con, sf_dir, fn, checks[name])
                note = "ok" if problem is None else "DIFF " + problem
            else:
                note = f"rows {len(fn(spark, sf_dir).collect())}"
                problem = None
        except Exception as error:  # noqa: BLE001
            problem = note = "ERROR " + str(error)[:1500]
        bad += problem is not None
        print(f"{name}: {time.time() - start:.1f}s {note[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
