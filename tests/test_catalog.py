import datetime
import os

import duckdb
import pytest

from lumenreel import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_gives_what_the_sql_gives(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    assert rows == sorted(([plain(r[found.columns.index(c)]) for c in columns] for r in found.fetchall()), key=repr)


def test_every_frame_has_its_nearest_placement(spark):
    q = catalog.queries()
    place = {(r.user_id, r.i): r.cum for r in q["positions"](spark, SF).collect()}
    bias = {(r.user_id, r.i): 1 for r in q["bridge_points"](spark, SF).collect()} | {(r.user_id, r.i): 0 for r in q["keyframes"](spark, SF).collect()}
    want = {}
    for user, i in place.keys() - bias.keys():
        options = [(abs(place[user, i] - place[user, k]) + b, k) for (u, k), b in bias.items() if u == user]
        if options:
            want[user, i] = min(options)
    got = q["nearest_placement"](spark, SF).collect()
    assert len(got) == len(want) > 0.5 * len(place) and {(r.user_id, r.i): (r.far, r.anchor) for r in got} == want


def test_fuzzy_report_counts_both_directions(spark, duck):
    from lumenreel.functions.text import token_set_score

    lines = []
    for table in ("documents", "benchmark"):
        texts = {" ".join(line.split()) for (text,) in duck.sql(f"SELECT text FROM {table} WHERE text IS NOT NULL").fetchall() for line in text.split("\n")}
        lines.append(sorted(t for t in texts if len(t) >= 3))
    source, stitched = lines
    hits = [(a, b) for a in source for b in stitched if token_set_score(a, b) >= 85]
    got = catalog.queries()["reconcile_fuzzy_report"](spark, SF).first()
    assert (got.n_source, got.n_stitched) == (len(source), len(stitched))
    assert (got.missing, got.unmatched) == (len(source) - len({a for a, _ in hits}), len(stitched) - len({b for _, b in hits}))
    exact = catalog.queries()["reconcile_report"](spark, SF).first()
    assert got.missing < exact.missing and got.unmatched < exact.unmatched
