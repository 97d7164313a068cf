"""Run registered queries next to their DuckDB text and compare the rows.

``python -m tests.oracle [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import importlib
import math
import pkgutil
import sys
import time
from collections import Counter

import duckdb

import linewright.plans as plans
from linewright.plans.registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def load_all() -> None:
    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"linewright.plans.{module.name}")


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return f"{value:.9g}f"
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        return tuple(_kind(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(_kind(row[i]) for i in order) for row in rows
    )


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    got_df = QUERIES[name](spark, sf_dir)
    got = rows_of(got_df.columns, [tuple(r) for r in got_df.collect()])
    spent = time.time() - start
    if name not in ORACLES:
        return True, f"rows only, {sum(got[1].values())} rows, {spent:.2f}s"
    start = time.time()
    cur = con.execute(ORACLES[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    other = time.time() - start
    spark_types = {f.name: f.dataType.simpleString() for f in got_df.schema.fields}
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    wrong = {
        c: (spark_types[c], duck_types.get(c))
        for c in spark_types
        if _TYPES.get(spark_types[c], duck_types.get(c)) != duck_types.get(c)
    }
    if wrong:
        return False, f"types differ: {wrong}"
    note = f"{sum(got[1].values())} rows, {spent:.2f}s, duckdb {other:.2f}s"
    if got == want:
        return True, note
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    extra, missing = got[1] - want[1], want[1] - got[1]
    return False, (
        f"{note}; want {sum(want[1].values())}; only spark {sum(extra.values())}: "
        f"{str(list(extra)[:2])[:700]}; only duckdb {sum(missing.values())}: {str(list(missing)[:2])[:700]}"
    )


def main(argv: list[str]) -> int:
    from linewright.session import build_session

    load_all()
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(QUERIES)
    spark = build_session(
        master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for pattern in wanted:
        for name in [n for n in QUERIES if n == pattern or (pattern.endswith("*") and n.startswith(pattern[:-1]))]:
            try:
                good, note = compare(spark, con, sf_dir, name)
            except Exception as error:  # report and go on with the next query
                good, note = False, f"{type(error).__name__}: {str(error)[:900]}"
            failed += not good
            print("ok  " if good else "FAIL", name, note, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
