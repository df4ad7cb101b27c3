"""Every query with an oracle gives the oracle's rows at the smallest scale, sources and sinks also at a larger one, whose texts hold quotes."""

import os

import duckdb
import pytest

from __spark_entry__ import entry
from sievekit.plans import ORACLE, QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Modes of one operator: one of each kind is enough here, the driver runs all.
SLOW = {"retrieve_always", "retrieve_traces", "retrieve_paraphrases", "retrieve_random"}


def opened(folder):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            db.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return db


@pytest.fixture(scope="module")
def duck():
    return opened(SF)


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, sorted(tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in plain)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_same_rows(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if n.startswith(("src_", "snk_"))))
def test_same_files(spark, name):
    assert rows(QUERIES[name](spark, LARGER).toPandas()) == rows(opened(LARGER).execute(ORACLE[name]).df())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() >= 1
