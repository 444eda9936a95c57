"""Every query with SQL against DuckDB, on the smallest tables and on the driver's correctness tables."""

import math
import os

import duckdb
import pytest

from sparquill import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


LARGE = ("g1_j7_p9_triangles", "g2_p10_quads", "j5_triangle_neighbours", "j6_quad_neighbours")


@pytest.fixture(scope="module")
def duck():
    made = {}

    def connect(sf):
        if sf not in made:
            made[sf] = duckdb.connect()
            for t in TABLES:
                p = f"/root/testdata/{sf}/{t}.parquet"
                made[sf].sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
        return made[sf]

    return connect


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v + 0.0:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("sf", os.environ.get("CATALOG_SF", "sf0.001").split(","))
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name, sf):
    df = catalog.queries()[name](spark, f"/root/testdata/{sf}")
    if name in LARGE:  # millions of rows: compared by DuckDB itself
        found, con = df.toArrow(), duck(sf)
        columns = ", ".join(sorted(df.columns))
        con.sql(f"CREATE OR REPLACE TEMP TABLE want AS SELECT {columns} FROM ({catalog.oracle_sql()[name]})")
        con.sql(f"CREATE OR REPLACE TEMP TABLE got AS SELECT {columns} FROM found")
        assert con.sql("SELECT (SELECT count(*) FROM got) - (SELECT count(*) FROM want), (SELECT count(*) FROM (FROM got EXCEPT ALL FROM want))").fetchall() == [(0, 0)]
        return
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck(sf).sql(catalog.oracle_sql()[name])
    assert got == rows(want.columns, want.fetchall())
