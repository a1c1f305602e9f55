"""Compare queries with their SQL on the given tables: ``python tests/oracle.py [folder] [name…]``."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def run_sql(folder, sql):
    db = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = db.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def compare(spark, folder, name, run, sql):
    """None if equal, else what differs."""
    df = run(spark, folder)
    columns = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*columns).collect()]
    if sql is None:
        return None if mine else "no rows"
    names, rows = run_sql(folder, sql)
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = [tuple(r[i] for i in order) for r in rows]
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    off = [(a, b) for a, b in zip(sorted(mine, key=repr), sorted(theirs, key=repr)) if a != b or repr(a) != repr(b)]
    return f"{len(off)} of {len(mine)} rows differ, as {columns}: {off[:3]}" if off else None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from pulsegrid.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    sqls = oracle_sql()
    for name, run in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        begin = time.time()
        try:
            verdict = compare(session, folder, name, run, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"CHECK {name:22s} {'ok' if verdict is None else 'FAIL'} {'sql' if name in sqls else 'rows'} {time.time() - begin:.1f}s {verdict or ''}", flush=True)
