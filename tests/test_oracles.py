"""Every registered query of the reference's operators against its SQL."""

import pytest

from sparrowdex.plans import reference, rest, sources  # noqa: F401  they register their queries


@pytest.mark.parametrize("name", sorted(reference.QUERIES))
def test_same_rows(name, spark, sf, duck, multiset):
    got = reference.QUERIES[name](spark, sf).toPandas()
    assert multiset(got) == multiset(duck.sql(reference.SQL[name]).df())


@pytest.mark.parametrize("name", ["streamed_documents", "streamed_events"])
def test_streams_of_folders(name, spark, sf, duck, multiset, tmp_path):
    """A table may be a folder of several files as well as a single one."""
    for t in ("conversations", "events"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = reference.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert multiset(got) == multiset(duck.sql(reference.SQL[name]).df())


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
