"""Run queries beside their SQL: python tests/compare.py [sf] [query ...]. Prints a line a query."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(float(r[i])) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in rows)), [names[i] for i in order]


def main(sf="sf0.01", *only):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    d = f"/root/testdata/{sf}"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    sql = entry.oracle_sql()
    for name, f in entry.queries().items():
        if only and name not in only and not any(o.endswith("*") and name.startswith(o[:-1]) for o in only):
            continue
        t = time.time()
        try:
            df = f(spark, d)
            got = df.collect()
            took = time.time() - t
            if name not in sql:
                print(f"rows  {name} {len(got)} {took:.1f}s", flush=True)
                continue
            res = db.execute(sql[name])
            want, names = rows_of([c[0] for c in res.description], res.fetchall())
            mine, own = rows_of(df.columns, got)
            ok = want == mine and names == own
            print(f"{'ok   ' if ok else 'DIFF '} {name} {len(mine)} {len(want)} {took:.1f}s", flush=True)
            if not ok:
                print("   spark", own, [x for x in mine if x not in set(want)][:3], "\n   sql  ", names, [x for x in want if x not in set(mine)][:3])
        except Exception as e:
            print(f"FAIL  {name} {str(e)[:1200]}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
