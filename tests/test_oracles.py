"""Every registered query of this library against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from slateledger.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal, int)):
        return "nan" if math.isnan(float(v)) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_round_trip_of_rendered_invoices(spark, sf):
    """What is rendered and parsed again has the values that went in."""
    from slateledger.plans import render

    inv = render.invoices(spark, sf).where("code <> '25'")
    for layout, query in (("image", "q_parse_line"), ("register", "q_parse_itc")):
        got = QUERIES[query](spark, sf).join(inv.selectExpr("doc_id", "ord", "gstin as id", "inv_date", "value"), ["doc_id", "ord"])
        assert got.where("GSTIN <> id or INVOICE_DATE <> inv_date").count() == 0, layout
        assert got.where("cast(INVOICE_VALUE as decimal(15,2)) <> value").count() == 0, layout
