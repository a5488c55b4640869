"""Run registered queries next to their SQL on DuckDB and compare the rows.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v.is_integer() and abs(v) < 1e15 else repr(v))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str(tuple(_cell(r[i]) for i in order)) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    table = df.toArrow()
    t1 = time.time()
    spark_cols, spark_rows = _rows(table.column_names, list(zip(*[c.to_pylist() for c in table.columns])) if table.num_columns and table.num_rows else [])
    if sql is None:
        return f"rows-only n={len(spark_rows)} {t1 - t0:.1f}s", True
    cur = con.execute(sql).to_arrow_table()
    t2 = time.time()
    duck_cols, duck_rows = _rows(cur.column_names, list(zip(*[c.to_pylist() for c in cur.columns])) if cur.num_rows else [])
    types = {f.name: (str(f.type), str(cur.schema.field(f.name).type)) for f in table.schema if f.name in cur.column_names}
    odd = {k: v for k, v in types.items() if v[0] != v[1] and not v[0].endswith("string") and "timestamp" not in v[0]}
    note = f" types={odd}" if odd else ""
    if spark_cols != duck_cols:
        return f"COLUMNS {spark_cols} vs {duck_cols}", False
    if spark_rows != duck_rows:
        a, b = [r for r in spark_rows if r not in set(duck_rows)][:3], [r for r in duck_rows if r not in set(spark_rows)][:3]
        return f"DIFF n={len(spark_rows)}/{len(duck_rows)}\n   spark {a}\n   duck  {b}", False
    return f"ok n={len(spark_rows)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s{note}", True


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tests.session import make_session

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    failed = []
    for name in names:
        try:
            text, ok = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            text, ok = f"ERROR {type(e).__name__}: {str(e)[:1500]}", False
        print(f"{name}: {text}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
