"""Run the registered queries against their DuckDB twins: ``python -m checks.compare SF [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from weblode.session import build_session

from .catalog import ORACLES, QUERIES


def rows_of(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(v: object) -> str:
        if isinstance(v, bool) or v is None:
            return str(v)
        return repr(float(v)) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted("|".join(show(r[i]) for i in order) for r in rows)


def main(sf: str, names: list[str]) -> int:
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "10g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    failed = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows {name} {len(got)} {took:.1f}s", flush=True)
                continue
            rel = con.sql(ORACLES[name])
            want = rows_of(rel.columns, rel.fetchall())
            same = got == want and sorted(rel.columns) == sorted(df.columns)
            print(f"{'ok  ' if same else 'DIFF'} {name} {len(got)}/{len(want)} {took:.1f}s", flush=True)
            if not same:
                failed += 1
                print("   ", sorted(df.columns), sorted(rel.columns))
                have, need = set(got), set(want)
                for line in list(have - need)[:3]:
                    print("    spark ", line[:300])
                for line in list(need - have)[:3]:
                    print("    duckdb", line[:300])
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name} {str(error)[:700]}", flush=True)
        spark.catalog.clearCache()
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
