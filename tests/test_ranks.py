"""The full sorts give every row, ranked from 1."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill import registry
from quarrymill.operators import relational as R
from quarrymill.sources import model
from tests.test_queries import DATA

FULL = {"SRT1_company_rank": "companies", "SRT2_seed_rank": "companies", "SRT3_contact_rank": "contacts", "SRT4_decision_rank": "contacts", "SRT6_listing_rank": "companies", "SRT8_ui_sorts": "companies", "SRT10_searches_by_update": "searches"}


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", FULL)
def test_no_row_is_cut(spark, name):
    n = getattr(model, FULL[name])(spark, str(DATA)).count()
    found = [r["rank"] for r in registry.QUERIES[f"{name}_all"](spark, str(DATA)).collect()]
    assert n > 50 and sorted(found) == list(range(1, n + 1))


def test_ranks_over_many_buckets(spark):
    rows = [(i, random.Random(i).choice([None, 1, 2, 2, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v int")
    found = {r["id"]: r["rank"] for r in R.ranked(df, [-F.col("v"), F.col("id")]).collect()}
    assert [i for i, _ in sorted(found.items(), key=lambda x: x[1])] == [i for i, v in sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))]
    assert sorted(found.values()) == list(range(1, 3001))
    assert R.ranked(df.where("id < 0"), [F.col("id")]).count() == 0
