"""Compare a Spark result with DuckDB SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def differences(con, df, sql: str) -> tuple[int, int]:
    """Rows that only one side has, counting repetitions; columns must agree in name and type."""
    con.register("made", df.toArrow())
    con.execute(f"CREATE OR REPLACE TEMP TABLE expected AS {sql}")
    kinds = [sorted((r[0], r[1]) for r in con.execute(f"DESCRIBE {t}").fetchall()) for t in ("made", "expected")]
    assert kinds[0] == kinds[1]
    cols = ", ".join(f'"{n}"' for n, _ in kinds[0])
    count = lambda a, b: con.execute(f"SELECT count(*) FROM (SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b})").fetchall()[0][0]
    return count("made", "expected"), count("expected", "made")
