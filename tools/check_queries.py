"""Run registered queries against their SQL on one folder of tables.

    python tools/check_queries.py [folder] [name ...]
"""

import math
import sys
import tempfile
import time
import traceback

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from wildgrid.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, function, sql):
    """(verdict, rows): exact equality of names, value types and values."""
    df = function(spark, folder)
    mine_columns, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "no sql", mine
    relation = con.sql(sql)
    their_columns, theirs = rows_of(list(relation.columns), relation.fetchall())
    if mine_columns != their_columns:
        return f"columns {mine_columns} <> {their_columns}", mine
    if len(mine) != len(theirs):
        return f"rows {len(mine)} <> {len(theirs)}", mine
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"values {a} <> {b}", mine
    return "ok", mine


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main():
    from wildgrid.plans import catalogue

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = catalogue.load()
    names = sys.argv[2:] or list(queries)
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-")})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            verdict, rows = compare(spark, con, folder, queries[name], oracles.get(name))
        except Exception as error:
            verdict, rows = f"error {str(error)[:600]}", []
            if len(names) < 4:
                traceback.print_exc()
        bad += verdict not in ("ok", "no sql")
        print(f"{name:28s} {len(rows):7d} rows {time.time() - start:6.2f}s  {verdict}", flush=True)
        if verdict == "no sql":
            print("    ", rows[:3])
    print("failed:", bad)


if __name__ == "__main__":
    main()
