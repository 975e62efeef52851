"""Run registered queries and their oracles side by side and compare rows and types.

    python -m tools.check_oracle [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

_TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def _value(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, Decimal):
        return str(v.normalize())
    return str(v)


def _bag(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def compare(df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences in column names, types and the bag of rows."""
    found = df.collect()
    wanted = db.execute(sql)
    types = {d[0]: str(d[1]) for d in wanted.description}
    columns = [d[0] for d in wanted.description]
    expected = wanted.fetchall()
    have = {
        f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
        for f in df.schema.fields
    }
    problems = []
    if have != types:
        problems.append(f"types: ours {sorted(have.items() - types.items())} "
                        f"oracle {sorted(types.items() - have.items())}")
    ours, theirs = _bag(df.columns, found), _bag(columns, expected)
    if ours != theirs:
        problems.append(f"rows {len(found)} vs {len(expected)}: "
                        f"ours {list((ours - theirs).items())[:4]} "
                        f"oracle {list((theirs - ours).items())[:4]}")
    return problems


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from snapgate.queries import ORACLES, QUERIES
    from snapgate.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark, db, bad = local_session("check", 8), open_tables(folder), 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problems = compare(df, db, ORACLES[name]) if name in ORACLES else []
            if name not in ORACLES:
                df.count()
        except Exception as error:  # noqa: BLE001
            problems = [str(error)[:600]]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok ':3} {name:32} {time.time() - start:6.2f}s "
              + " | ".join(problems))
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
