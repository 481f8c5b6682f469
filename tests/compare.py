"""Runs registered queries beside their SQL in DuckDB. As a script: python tests/compare.py SF_DIR [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, bytes | bytearray):
        return bytes(x).hex()
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    return None if x is None else x if isinstance(x, bool) else f"{float(x):.6g}" if type(x).__name__ == "Decimal" else str(x)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            path = Path(f"{sf_dir}/{t}.parquet")
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
        found = db.execute(sql)
        names = [c[0] for c in found.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def difference(df, sql: str, sf_dir: str) -> str | None:
    names, got = spark_rows(df)
    want_names, want = duck_rows(sql, sf_dir)
    if names != want_names:
        return f"columns {names}, in SQL {want_names}"
    if got != want:
        more, fewer = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows, in SQL {len(want)}; only here {more}, only there {fewer}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in queries:
        if not names or any(name == n or n.endswith("*") and name.startswith(n[:-1]) for n in names):
            began = time.time()
            try:
                df = queries[name](spark, sf_dir)
                said = difference(df, oracles[name], sf_dir) if name in oracles else f"{df.count()} rows, no SQL"
            except Exception as e:
                said = f"ERROR {type(e).__name__} {str(e)[:700]}"
            print(f"{'ok' if said is None else said} {name} {time.time() - began:.1f} s", flush=True)
