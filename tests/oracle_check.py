"""Runs registered queries and their SQL side by side: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else round(float(value), 6)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def family(kind: str) -> str:
    """Kinds of values that compare alike, for the type names of both engines."""
    kind = kind.lower()
    for name, words in {
        "list": ("array", "list", "[]"), "number": ("int", "long", "number", "short", "byte", "double", "float", "decimal"), "text": ("string", "varchar", "char"),
        "flag": ("bool",), "time": ("timestamp", "datetime"), "date": ("date",), "bytes": ("binary", "blob"),
    }.items():
        if any(w in kind for w in words):
            return name
    return ""


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, sf_dir, name, fn, sql):
    started = time.time()
    df = fn(spark, sf_dir)
    got = normalise(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if sql is None:
        return took, len(got[1]), "rows only" if got[1] else "NO ROWS"
    rel = con.execute(sql)
    want = normalise([d[0] for d in rel.description], rel.fetchall())
    kinds = {d[0]: family(str(d[1])) for d in rel.description}
    other = [f"{c} {k} / {kinds[c]}" for c, k in df.dtypes if kinds.get(c, k) and c in kinds and family(k) != kinds[c]]
    if got == want:
        if other:
            return took, len(got[1]), f"DIFFERENT types {', '.join(other)}"
        return took, len(got[1]), "ok" if got[1] else "ok BUT EMPTY"
    problem = f"columns {got[0]} / {want[0]}" if got[0] != want[0] else f"rows {len(got[1])} / {len(want[1])}"
    have, wanted = set(got[1]), set(want[1])
    extra = [r for r in got[1] if r not in wanted][:3]
    missing = [r for r in want[1] if r not in have][:3]
    return took, len(got[1]), f"DIFFERENT {problem}\n   spark: {str(extra)[:900]}\n   sql:   {str(missing)[:900]}"


def main(argv):
    import __spark_entry__ as entry
    from episodika.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            took, rows, verdict = compare(spark, con, sf_dir, name, fn, entry.oracle_sql().get(name))
        except Exception as error:  # a broken query must not hide the others
            took, rows, verdict = 0.0, 0, f"ERROR {type(error).__name__}: {str(error)[:1200]}"
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:<36}{took:7.2f}s {rows:>7} rows  {verdict}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
