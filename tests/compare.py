"""Run registered queries against their SQL and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    """One spelling for values of both engines."""
    if value is None:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else float(value)
    if isinstance(value, int):
        return int(value)
    return str(value)


def rows(names: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in data]
    out.sort(key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))
    return [names[i] for i in order], out


def differences(ours: tuple, theirs: tuple) -> str | None:
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}: {ours[1][:2]} / {theirs[1][:2]}"
    for row in ours[1] + theirs[1]:
        if any(isinstance(v, float) and v == 0 and math.copysign(1, v) < 0 for v in row):
            return f"negative zero in {row}"
    left, right = Counter(ours[1]), Counter(theirs[1])
    only_left, only_right = list((left - right).elements()), list((right - left).elements())
    if only_left or only_right:
        return f"{len(only_left)} rows differ, ours {only_left[:2]} / sql {only_right[:2]} ({ours[0]})"
    types = [{type(row[i]) for row in side if row[i] is not None} for side in (ours[1], theirs[1])
             for i in range(len(ours[0]))]
    half = len(types) // 2
    if types[:half] != types[half:]:
        return f"types differ {types}"
    return None


def check(spark, sf_dir: str, name: str, function, sql: str | None, connection) -> tuple[str | None, int, float, float]:
    start = time.time()
    frame = function(spark, sf_dir)
    ours = rows(frame.columns, [tuple(row) for row in frame.collect()])
    spent = time.time() - start
    if sql is None:
        return None, len(ours[1]), spent, 0.0
    start = time.time()
    result = connection.execute(sql)
    theirs = rows([c[0] for c in result.description], result.fetchall())
    return differences(ours, theirs), len(ours[1]), spent, time.time() - start


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from atomweave.session import local_session
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    db, failed = connect(sf_dir), []
    oracle = entry.oracle_sql()
    for name, function in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            problem, count, ours, theirs = check(spark, sf_dir, name, function, oracle.get(name), db)
        except Exception as error:  # report and go on with the next query
            problem, count, ours, theirs = f"{type(error).__name__}: {str(error)[:600]}", 0, 0.0, 0.0
        if problem:
            failed.append(name)
        state = "FAIL " + problem if problem else ("ok" if name in oracle else "rows only")
        print(f"{name:34s} {count:8d} {ours:6.2f}s {theirs:6.2f}s {state}", flush=True)
    print("failed:", failed)
