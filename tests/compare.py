"""Run the named queries on Spark and their SQL on DuckDB, and compare all rows.

    python tests/compare.py [folder] [query ...]
"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark_df, con, sql):
    """None when equal, else a short description."""
    cols = spark_df.columns
    got = canonical(cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canonical(names, cur.fetchall())
    if sorted(cols) != sorted(names):
        return f"columns {sorted(cols)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:2]}" if bad else None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = []
    for name, run in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t0 = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                why = difference(df, con, sqls[name])
            else:
                why = None if df.count() else "no rows"
        except Exception as err:  # noqa: BLE001
            why = f"{type(err).__name__}: {str(err)[:1500]}"
        print(f"{'ok  ' if why is None else 'BAD '} {name:28s} {time.time() - t0:6.1f}s "
              f"{'' if name in sqls else '(rows only) '}{why or ''}", flush=True)
        if why:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
