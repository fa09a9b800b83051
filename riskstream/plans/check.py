"""Compare a registered query with its DuckDB oracle (order-insensitive)."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def rows_of(pdf) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return sorted(out)


def compare(spark_df, con, sql: str) -> dict:
    sp = spark_df.toPandas()
    dk = con.execute(sql).fetchdf()
    res = {"spark_rows": len(sp), "oracle_rows": len(dk),
           "cols_match": sorted(sp.columns) == sorted(dk.columns)}
    if not res["cols_match"]:
        res["spark_cols"], res["oracle_cols"] = sorted(sp.columns), sorted(dk.columns)
        res["match"] = False
        return res
    a, b = rows_of(sp), rows_of(dk)
    res["match"] = a == b
    if not res["match"]:
        sa, sb = set(a), set(b)
        res["only_spark"] = sorted(sa - sb)[:3]
        res["only_oracle"] = sorted(sb - sa)[:3]
    return res


def main(argv: list[str] | None = None) -> int:
    """``python -m riskstream.plans.check [sf_dir] [query ...]``: run
    registered queries against their DuckDB oracle, one JSON line each."""
    import json
    import sys
    import time

    from ..session import get_spark
    from .oracle import ORACLE
    from .queries import QUERIES
    args = list(sys.argv[1:] if argv is None else argv)
    sf = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or sorted(QUERIES)
    spark = get_spark("local[*]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    failed = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, sf)
            r = compare(df, con, ORACLE[n]) if n in ORACLE else {"rows": df.count(), "no_oracle": True}
        except Exception as e:  # report and continue with the next query
            r = {"error": repr(e)[:500]}
        failed += int(not r.get("match") and not r.get("no_oracle"))
        r["sec"] = round(time.time() - t0, 2)
        print(json.dumps({"query": n, **r}, default=str), flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
