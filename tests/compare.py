"""Run registered queries and their SQL side by side: ``python tests/compare.py 0.01 [names]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(value):
    if isinstance(value, bool):
        return "bool"
    return {int: "int", float: "float", str: "str", type(None): "null"}.get(type(value), "other")


def _key(row):
    return tuple((v is None, str(_kind(v)), v if v is not None else 0) for v in row)


def difference(spark_df, con, statement):
    """None where both results are the same multiset of equal rows, else a description."""
    result = con.execute(statement)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    order = sorted(names)
    theirs = sorted(
        (tuple(r[names.index(c)] for c in order) for r in result.fetchall()), key=_key
    )
    ours = sorted((tuple(r) for r in spark_df.select(*order).collect()), key=_key)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for mine, other in zip(ours, theirs):
        for column, a, b in zip(order, mine, other):
            same = _kind(a) == _kind(b) and (a == b or (_kind(a) == "float" and math.isnan(a) and math.isnan(b)))
            if not same:
                return f"{column}: {str(a)[:200]!r} != {str(b)[:200]!r} ({_kind(a)}, {_kind(b)}) in {str(mine)[:300]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from kinvote.session import build_session

    spark = build_session(
        "compare",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    folder = f"/root/testdata/sf{sys.argv[1]}"
    con, wanted = connect(folder), set(sys.argv[2:])
    bad = []
    for name, statement in entry.oracle_sql().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            found = difference(entry.queries()[name](spark, folder), con, statement)
        except Exception as error:  # report and go on
            found = f"{type(error).__name__}: {str(error)[:400]}"
        print(f"{name:26s} {time.time() - start:6.1f}s {'ok' if found is None else found}", flush=True)
        if found is not None:
            bad.append(name)
    print("different:", bad)
