"""Run registered queries in Spark and DuckDB and compare them: ``python tests/parity_check.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    from datetime import datetime
    from decimal import Decimal

    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value.asDict().values())
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    from silverprint.parity.registry import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return True, f"{len(got)} rows, no SQL"
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(columns)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} rows against {len(want)}; only Spark {extra}; only SQL {missing}"
    return True, f"{len(got)} rows equal; " + ",".join(f"{c}:{str(d[1])}" for c, d in zip(columns, result.description))


def main() -> None:
    import __spark_entry__ as entry
    from tests.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for name in names or list(entry.queries()):
        started = time.time()
        try:
            ok, text = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {text[:1500]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
