"""What a refresh leaves on disk: packed tables, and no shuffle of a layer that is written."""

import glob
import gzip
import time

import pytest

from tallyloom import fixed_values as fv
from tallyloom.operators import quality, sales
from tallyloom.plans import refresh as job
from tallyloom.session import WRITING, scratch_path, writing

HEAD = ",".join(fv.CSV_HEADERS)


def shuffles(spark) -> set[str]:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {b for b in blocks.split() if b.startswith("shuffle_")}


def lines_of(first: int, n: int) -> list[str]:
    return [f"{i // 3},{i % 7 + 10},mug {i % 7},{i % 4},2020-01-0{i % 9 + 1} 08:00:00,1.50,{i % 5},UK" for i in range(first, first + n)]


@pytest.fixture()
def landed(spark, tmp_path):
    """Sales in a plain and a gzipped file with a line in both, and one that is still being delivered; events as JSON."""
    folders = [tmp_path / "csv", tmp_path / "jsonl"]
    for folder in folders:
        folder.mkdir()
    (folders[0] / "a.csv").write_text("\n".join([HEAD, *lines_of(0, 40)]) + "\n")
    (folders[0] / "b.csv.gz").write_bytes(gzip.compress(("\n".join([HEAD, *lines_of(39, 40)]) + "\n").encode()))
    (folders[0] / "c.csv.gz.part").write_bytes(b"half a file")
    event = '{"event_id": "e%d", "session_id": "s%d", "visitor_id": "v", "event_type": "%s", "event_ts": "2020-01-01T08:00:00"}'
    (folders[1] / "a.json.gz").write_bytes(gzip.compress("\n".join(event % (i, i % 3, "hover" if i == 5 else "view") for i in range(30)).encode()))
    return [f"file://{f}" for f in folders]


def test_no_shuffle_stays_and_tables_are_packed(spark, landed):
    root = scratch_path(spark, "disk")
    before = shuffles(spark)
    job.refresh_landed(spark, *landed, root)
    until = time.time() + 20  # files are removed in the background
    while (left := shuffles(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    home = job.published(spark, root)
    for table in [f"{home}/{name}" for name in job.STORED] + [f"{root}/bronze_sales", f"{root}/bronze_events"]:
        files = glob.glob(f"{table.removeprefix('file://')}/**/*.parquet", recursive=True)
        assert files and all(f.endswith(".zstd.parquet") for f in files), table


def test_plain_and_gzipped_deliveries_are_refreshed_alike(spark, landed):
    root = scratch_path(spark, "disk")
    job.refresh_landed(spark, *landed, root)
    home = job.published(spark, root)
    bronze = spark.read.parquet(f"{root}/bronze_sales")
    assert {(r["_source_file"], r["count"]) for r in bronze.groupBy("_source_file").count().collect()} == {("a.csv", 40), ("b.csv.gz", 40)}
    tagged = spark.read.parquet(f"{home}/tagged_sales")
    assert tagged.count() == 79 and tagged.where("_source_file = 'b.csv.gz'").count() == 39  # the line of both is the first file's
    got = {(r.feed, r.rule): (r.passed, r.failed) for r in spark.read.parquet(f"{home}/expectations").collect()}
    assert got["sales", "no_negative_qty_outside_returns"] == (59, 20) and got["events", "known_event_type"] == (29, 1)


def test_settings_hold_for_the_refresh_alone(spark):
    (key, other), split = WRITING, "spark.sql.files.maxPartitionBytes"
    first = spark.conf.get(key, None)
    for own, held in (("16m", 16 << 20), ("128m", 32 << 20)):
        spark.conf.set(other, "5")
        spark.conf.set(split, own)
        try:
            with pytest.raises(ValueError), writing(spark):
                assert [spark.conf.get(k) for k in WRITING] == [*WRITING.values()] and spark.conf.get(split) == str(held)
                raise ValueError
            assert spark.conf.get(other) == "5" and spark.conf.get(key, None) == first and spark.conf.get(split) == own
        finally:
            spark.conf.unset(other)
            spark.conf.unset(split)


def test_rows_lie_by_customer_and_are_those_of_the_key(spark):
    assert sorted(sales.LIE_BY) == sorted(fv.SALES_KEY)
    schema = ", ".join(f"{c} STRING" for c in [*fv.SALES_KEY, "_source_file"])
    rows = [("9", "10", "mug", "1", "d", "1", "7", "UK", "b"), ("9", "10", "mug", "1", "d", "1", "7", "UK", "a"), ("1", "10", None, "1", "d", "1", None, "UK", None), ("5", "11", "cup", "1", "d", "1", "7", "UK", "a")]
    bronze = spark.createDataFrame(rows, schema)
    old = quality.tag(quality.without_copies(bronze, fv.SALES_KEY), quality.sales_rules())
    new = sales.tagged_sales(bronze)
    assert new.columns == old.columns and new.exceptAll(old).count() == old.exceptAll(new).count() == 0
    assert "Aggregate [country#" in new._jdf.queryExecution().optimizedPlan().toString()
