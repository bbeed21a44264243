"""What the physical plans must look like at any data size."""

import pytest
from pyspark.sql import functions as F

from estatespark import session
from estatespark.operators import area_stats, encoding, projections, splits
from estatespark.plans.enrichment import base_features, enrich
from estatespark.session import as_table, joinable
from estatespark.verification.views import view

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_enrichment_keeps_the_wide_rows_in_place(spark):
    listings = as_table(view(spark, SF_DIR, "listing"), "listings")
    text = plan(enrich(listings))
    assert text.count("BroadcastHashJoin") == 5
    assert "SortMergeJoin" not in text and "hashpartitioning" not in text
    assert "Python" not in text and "Pandas" not in text


def test_enrichment_reads_the_source_once_to_fit_and_once_to_join(spark, tmp_path, monkeypatch):
    """The fits read a narrow copy, which is the one table written from the source; the result scans the source once more."""
    path = str(tmp_path / "source-listings")
    view(spark, SF_DIR, "listing").write.parquet(path)
    written = []

    def reads_source(df) -> bool:
        return any("source-listings" in f for f in df.inputFiles())

    def keep(df, label, partition_by=None):
        written.append((label, reads_source(df)))
        return as_table(df, label, partition_by)

    monkeypatch.setattr(area_stats, "as_table", keep)
    enriched = enrich(spark.read.parquet(path))
    assert [label for label, scans in written if scans] == ["area-prices"]
    # The wide scan is the one that has the key.
    assert reads_source(enriched) and plan(enriched).count("FileScan parquet [listing_id") == 1


def test_rows_do_not_depend_on_the_broadcast_limit(spark, monkeypatch):
    """The same codes when the dictionaries are just small enough to be broadcast, and when they are not."""
    df = spark.range(3000).select(F.col("id").alias("listing_id"), F.when(F.col("id") % 3 > 0, (F.col("id") % 500).cast("string")).alias("c"))
    size = as_table(df.select("c").distinct().where("c is not null"), "values").agg(F.sum(F.octet_length("c") + 32)).first()[0]
    found = []
    for limit in (size, size - 1):
        monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
        coded = encoding.fit_ordinal(df, ["c"]).transform(df)
        found.append((plan(coded).count("BroadcastHashJoin") > 0, sorted(map(tuple, coded.collect()))))
    assert found[0][0] and found[0][1] == found[1][1]


def test_cleaning_and_splits_do_not_shuffle(spark):
    listings = as_table(view(spark, SF_DIR, "listing"), "listings")
    text = plan(projections.prepare(listings).where(splits.is_fit()))
    assert "Exchange" not in text and "Python" not in text


def test_only_the_needed_columns_are_read(spark):
    listings = as_table(view(spark, SF_DIR, "listing"), "listings")
    text = plan(projections.add_department(listings).select("department").where(F.col("department") == "01"))
    assert "ReadSchema: struct<postal_code:bigint>" in text


def test_price_statistics_combine_before_one_shuffle(spark):
    listings = as_table(view(spark, SF_DIR, "listing"), "listings")
    text = plan(area_stats.price_moments(area_stats.price_rows(base_features(listings), splits.is_fit())))
    assert text.count("hashpartitioning") == 1 and "partial_avg" in text
    assert text.count("FileScan") == 1 and "nb_photos" not in text and "land_size" not in text


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    big = as_table(spark.range(100).withColumnRenamed("id", "k"), "table")
    rows = spark.range(1000).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(rows.join(joinable(big), "k", "left"))
        monkeypatch.setattr(session, "BROADCAST_BYTES", 50)
        joined = rows.join(joinable(big), "k", "left")
        assert "SortMergeJoin" in plan(joined) and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_size_counts_the_text(spark):
    table = as_table(spark.createDataFrame([("abc", 1), ("é", 2), (None, 3)], "t string, n bigint"), "table")
    assert table.agg(F.sum(session.value_bytes(table))).first()[0] == 3 * 32 + 3 + 2


def test_codes_are_joined_not_looked_up_in_python(spark):
    df = projections.prepare(view(spark, SF_DIR, "listing"))
    text = plan(encoding.fit_ordinal(df).transform(df))
    assert "Python" not in text and "SortMergeJoin" not in text


class Context:
    """Stands for the context of a session that is not running here."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, configured=None, folder=None):
        self.sparkContext = Context(master, folder)
        self.conf = {"spark.checkpoint.dir": configured}


def test_the_shared_folder_is_the_configured_one():
    cluster = Session("spark://cluster:7077", "hdfs:///shared/")
    assert session.shared_dir(cluster) == "hdfs:///shared"
    assert cluster.sparkContext.folder == "hdfs:///shared/"
    assert session.shared_dir(Session("yarn", None, "hdfs:///set")) == "hdfs:///set"


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        session.shared_dir(Session("yarn"))


def test_written_tables_lie_in_the_shared_folder(spark):
    table = as_table(spark.range(3), "numbers")
    assert table.count() == 3 and all(session.shared_dir(spark) in f for f in table.inputFiles())
