"""Every registered query of the library against its SQL, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from loomcorpus import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    return con


def _sorted(rows, columns):
    return rows[columns].sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, DATA).toPandas(), duck.execute(plans.SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    pd.testing.assert_frame_equal(_sorted(got, columns), _sorted(want, columns), check_dtype=False)


def test_queries_without_sql_are_those_that_plain_python_checks():
    assert set(plans.QUERIES) - set(plans.SQL) == {"bestfit_audit", "bestfit_pack", "bpe_encode_stats", "bpe_vocabulary", "conversation_render", "displacement_stats", "distinct_assignment", "few_shot_pairs", "retrieval_refs", "seeded_head", "seeded_orders", "sft_mixture", "sft_pad_pack"}


def test_entry_has_stable_columns(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "vec_id", "content_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
