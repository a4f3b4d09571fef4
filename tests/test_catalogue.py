"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from palisade.plans import catalogue, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {**flagship.ORACLES, **catalogue.ORACLES}
QUERIES = {**flagship.QUERIES, **catalogue.QUERIES}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(frame):
    columns = sorted(frame.columns)
    rows = (tuple(None if x is None or (isinstance(x, float) and math.isnan(x)) else x.item() if hasattr(x, "item") else x for x in r) for r in frame[columns].itertuples(index=False))
    return columns, sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    assert normal(QUERIES[name](spark, SF).toPandas()) == normal(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["greedy_clusters", "component_clusters"])
def test_variants_of_one_repeat_come_together(spark, name):
    found = QUERIES[name](spark, SF).toPandas()
    assert found.gid.nunique() == 20 and len(found) == 120


def test_cleaning_settles_and_contigs_are_paths(spark):
    edges = QUERIES["clean_spacer_graph"](spark, SF).toPandas()
    assert len(edges) and len(edges.drop_duplicates()) == len(edges)
    contigs = QUERIES["contigs"](spark, SF).toPandas()
    assert not contigs.duplicated(["family", "spacer"]).any() and contigs.groupby("family").contig.min().eq(1).all()


def test_detection_finds_the_planted_repeats(spark):
    found = QUERIES["find_repeats"](spark, SF).toPandas()
    assert len(found) > 1400 and found.repeat_len.between(32, 40).mean() > 0.95


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
