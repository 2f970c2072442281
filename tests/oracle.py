"""Runs registered queries on Spark and on DuckDB and compares the rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return cols, types, Counter(tuple(canon(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, types, Counter(tuple(canon(r[i]) for i in at) for r in rel.fetchall())


NUMERIC = {"bigint": {"BIGINT"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "int": {"INTEGER"}}


def compare(spark, con, name, fn, sql, sf):
    s_cols, s_types, s_rows = spark_rows(fn(spark, sf))
    if sql is None:
        return None, f"rows {sum(s_rows.values())}"
    d_cols, d_types, d_rows = duck_rows(con, sql)
    if s_cols != d_cols:
        return False, f"columns {s_cols} vs {d_cols}"
    odd = [f"{c}:{s_types[c]}/{d_types[c]}" for c in s_cols if s_types[c] in NUMERIC and d_types[c] not in NUMERIC[s_types[c]]]
    if s_rows != d_rows:
        only_s, only_d = list((s_rows - d_rows).items())[:2], list((d_rows - s_rows).items())[:2]
        return False, f"{sum(s_rows.values())} vs {sum(d_rows.values())} rows\n   spark {only_s}\n   duck  {only_d}"
    if not s_rows:
        return False, "no rows"
    return True, f"rows {sum(s_rows.values())}" + (f" TYPES {odd}" if odd else "")


def main():
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from docledger.session import local_session

    import __spark_entry__ as e

    sf = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = local_session(), duck(sf)
    oracle, bad = e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, name, fn, oracle.get(name), sf)
        except Exception as exc:
            ok, note = False, str(exc)[:1500]
        bad += ok is False
        print(f"{'ok ' if ok else '-- ' if ok is None else 'BAD'} {name} {time.time() - t:.1f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
