"""Every registered query: against its check SQL; the few without one are tested by restatements elsewhere."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from lumenary.plans import registry

SF = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# test_jobs: images, arrival order of streamed clusters
ELSEWHERE = {"v4_phash_images", "v5_image_features", "w9_stream_clusters"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - ELSEWHERE))
def test_query(spark, con, name):
    assert compare(spark, con, SF, entry.queries()[name], CHECKS[name]) is None


@pytest.mark.parametrize("name", sorted(ELSEWHERE))
def test_query_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_no", "id", "score", "rank", "total"] and df.count() > 0
