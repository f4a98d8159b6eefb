"""Compare a Spark query result with its DuckDB oracle.

Checks row count, column names, column types (mapped between the engines) and
an order-insensitive comparison of the values. Floats must match exactly;
``near`` reports how many cells would match within 1e-9 relative tolerance
when they do not.
"""

from __future__ import annotations

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = [
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
][0].split()

_SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "integer": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "smallint": "SMALLINT",
    "tinyint": "TINYINT",
}


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _spark_types(df):
    out = {}
    for f in df.schema.fields:
        s = f.dataType.simpleString()
        if s.startswith("decimal"):
            out[f.name] = s.upper().replace(" ", "")
        elif s.startswith("array"):
            out[f.name] = s
        else:
            out[f.name] = _SPARK_TO_DUCK.get(s, s.upper())
    return out


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, repr(v))
    if isinstance(v, Decimal):
        return (3, str(v.normalize()) if v == v else "nan")
    if isinstance(v, (date, datetime)):
        return (4, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (5, repr([_norm(x) for x in v]))
    return (6, repr(v))


def compare(spark_df, con, sql: str) -> dict:
    rel = con.sql(sql)
    dcols = rel.columns
    dtypes = {c: str(t).upper().replace(" ", "") for c, t in zip(rel.columns, rel.types)}
    drows = rel.fetchall()
    scols = spark_df.columns
    stypes = _spark_types(spark_df)
    srows = [tuple(r) for r in spark_df.collect()]
    res = {"spark_rows": len(srows), "oracle_rows": len(drows)}
    res["columns_match"] = sorted(scols) == sorted(dcols)
    if not res["columns_match"]:
        res["spark_cols"], res["oracle_cols"] = sorted(scols), sorted(dcols)
        res["ok"] = False
        return res
    type_diff = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
    res["type_diff"] = type_diff
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    s_sorted = sorted(tuple(_norm(r[i]) for i in si) for r in srows)
    d_sorted = sorted(tuple(_norm(r[i]) for i in di) for r in drows)
    res["values_match"] = s_sorted == d_sorted
    if not res["values_match"] and len(s_sorted) == len(d_sorted):
        bad = 0
        exact_bad = 0
        sample = []
        for a, b in zip(s_sorted, d_sorted):
            if a != b:
                exact_bad += 1
                for x, y, name in zip(a, b, order):
                    if x != y:
                        ok = False
                        try:
                            fx, fy = float(x[1]), float(y[1])
                            ok = math.isclose(fx, fy, rel_tol=1e-9, abs_tol=1e-9)
                        except Exception:
                            pass
                        if not ok:
                            bad += 1
                            if len(sample) < 5:
                                sample.append((name, x, y))
        res["rows_differing"] = exact_bad
        res["cells_not_near"] = bad
        res["sample"] = sample
    res["ok"] = (
        res["columns_match"] and not type_diff and res["values_match"] and len(srows) == len(drows)
    )
    return res
