import pytest
from pyspark.sql import functions as F

from lakeops.sinks.tree import write_files
from lakeops.sources.files import list_objects, read_cohort, read_manifests
from lakeops.sources.registry import Dataset, Registry, Storage, read_matching
from lakeops.sources.store import Store
from lakeops.sources.tables import (
    daily_slice, list_partitions, partitioned_table, read_csv_dir, read_parquet_dir, read_window, rename_header,
)

REGISTRY = Registry(
    [Storage("red", "s3a://vault-1/"), Storage("deep", "s3a://vault-1/shelf/x"), Storage("idle", "s3a://idle")],
    [Dataset("raw_a_one", "red", "/raw/one"), Dataset("raw_a_two", "deep", "two"), Dataset("raw_ab_one", "red", "ab/one"),
     Dataset("curated_a_one", "deep", "c")],
)


def ids(found):
    return [d.id for d in found]


def test_wildcards_select_each_dataset_once():
    assert ids(REGISTRY.select(["raw_a_*", "raw_*_one", "nothing"])) == ["raw_a_one", "raw_a_two", "raw_ab_one"]
    assert ids(REGISTRY.select(["curated_a_one"])) == ["curated_a_one"]
    assert ids(REGISTRY.select(["*_one"])) == ["curated_a_one", "raw_a_one", "raw_ab_one"]
    with pytest.raises(LookupError, match="raw_zzz"):
        REGISTRY.select(["raw_zzz*"])


def test_addresses():
    assert REGISTRY.uri("raw_a_one") == "s3a://vault-1/raw/one"
    assert REGISTRY.uri("raw_a_two", scheme="s3") == "s3://vault-1/shelf/x/two"
    assert REGISTRY.bucket("raw_a_two") == "vault-1"
    assert [s.id for s in REGISTRY.storages_behind(REGISTRY.select(["raw_a_*"]))] == ["deep", "red"]
    assert REGISTRY.bucket_of_resource("raw", "ab") == "vault-1"
    with pytest.raises(LookupError):
        REGISTRY.bucket_of_resource("raw", "b")


def test_union_of_datasets_is_by_name(spark, fresh):
    root = fresh()
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(f"{root}/p/one")
    spark.createDataFrame([("y", 2)], "c string, a int").write.parquet(f"{root}/p/two")
    registry = Registry([Storage("s", root)], [Dataset("p_one", "s", "p/one"), Dataset("p_two", "s", "/p/two")])
    rows = {r._dataset: r for r in read_matching(spark, registry, ["p_*"]).collect()}
    assert (rows["p_one"].a, rows["p_one"].b, rows["p_one"].c) == (1, "x", None)
    assert (rows["p_two"].a, rows["p_two"].b, rows["p_two"].c) == (2, None, "y")


def days_table(spark, path):
    rows = [(f"2024-01-0{d}", i) for d in (1, 2, 3, 5) for i in range(3)]
    spark.createDataFrame(rows, "day string, v int").write.partitionBy("day").parquet(path)
    return partitioned_table(spark, path, "day")


def test_windows_are_half_open_and_never_empty(spark, fresh):
    table = days_table(spark, fresh())
    assert dict(table.dtypes)["day"] == "string"
    got = {r.day for r in read_window(table, ["day", "v"], "day", "2024-01-02", "2024-01-05").collect()}
    assert got == {"2024-01-02", "2024-01-03"}
    assert [r.day for r in list_partitions(table, "day", "2024-01-02", "2024-01-09").collect()] == ["2024-01-02", "2024-01-03", "2024-01-05"]
    for start, end in (("2024-01-02", "2024-01-02"), ("2024-01-03", "2024-01-02")):
        with pytest.raises(ValueError, match="empty window"):
            read_window(table, ["v"], "day", start, end)
        with pytest.raises(ValueError, match="empty window"):
            list_partitions(table, "day", start, end)


def test_partition_folders_are_listed_without_reading(spark, fresh):
    path = fresh()
    days_table(spark, path)
    assert Store(spark).partitions(path, "day") == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05"]


def test_parquet_folders_do_not_match_their_neighbours(spark, fresh):
    root = fresh()
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{root}/a/x")
    spark.createDataFrame([(2, 3)], "a int, b int").write.parquet(f"{root}/a/y")
    spark.createDataFrame([(9,)], "z int").write.parquet(f"{root}/ab")
    assert sorted((r.a, r.b) for r in read_parquet_dir(spark, f"{root}/a").collect()) == [(1, None), (2, 3)]
    assert set(read_parquet_dir(spark, f"{root}/a").columns) == {"a", "b"}
    with pytest.raises(FileNotFoundError):
        read_parquet_dir(spark, f"{root}/none")


def test_csv_files_with_different_headers(spark, fresh):
    root = fresh()
    files = [("t/a.csv", "k,v\n1,x\n2,\"y, z\"\n"), ("t/b.csv", "v,w\nq,7\n"), ("t/c.csv", "k,v\n3,u\n"), ("t/skip.txt", "k\n9\n"), ("tt/d.csv", "o\n1\n")]
    write_files(spark.createDataFrame(files, "path string, content string"), root).collect()
    rows = sorted((r.k, r.v, r.w) for r in read_csv_dir(spark, f"{root}/t").fillna("").collect())
    assert rows == [("", "q", "7"), ("1", "x", ""), ("2", "y, z", ""), ("3", "u", "")]
    with pytest.raises(FileNotFoundError):
        read_csv_dir(spark, f"{root}/missing")


def test_header_override_is_positional(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rename_header(df, ["x", "y"]).columns == ["x", "y"]
    assert rename_header(df, None).columns == ["a", "b"]
    with pytest.raises(ValueError):
        rename_header(df, ["x"])


def cohort(spark, fresh, text, accession="accessionNumber", exam="examDate"):
    root = fresh()
    write_files(spark.createDataFrame([("cohort.csv", text)], "path string, content string"), root).collect()
    return read_cohort(spark, f"{root}/cohort.csv", accession, exam, "dicoms")


def test_cohort_lists(spark, fresh):
    df = cohort(spark, fresh, "z,accessionNumber,examDate\n1,QX55,2031-07-04\n2,KD*, 2031-11-9 \n3,12,NA\n4,NULL,2031-07-04\n5,QX7,4 July 2031\n")
    rows = {r.accession: r for r in df.collect()}
    assert set(rows) == {"QX55", "KD*", "QX7"}
    assert rows["QX55"].pattern == "dicoms/2031/07/04/QX55"
    assert rows["KD*"].pattern == "dicoms/2031/11/09/KD*"
    assert rows["QX7"].pattern is None and "Y-M-D" in rows["QX7"].reject_reason


def test_cohort_lists_name_their_missing_columns(spark, fresh):
    with pytest.raises(ValueError, match="accessionNumber.*columns are.*accession"):
        cohort(spark, fresh, "accession,date\nQX7,2031-07-04\n")


def test_no_manifest_means_nothing_to_do(spark, fresh):
    root = fresh()
    write_files(spark.createDataFrame([("2024/01/02/a.idx", "documentId\n5\n"), ("2024/01/03/a.txt", "x")], "path string, content string"), root).collect()
    assert read_manifests(spark, root, ["2024/01/09"], "documentId bigint") is None
    assert read_manifests(spark, root, ["2024/01/03"], "documentId bigint") is None
    assert [r.documentId for r in read_manifests(spark, root, ["2024/01/02"], "documentId bigint").collect()] == [5]


def test_listing_is_relative_to_its_root(spark, fresh):
    root = fresh()
    write_files(spark.createDataFrame([("a/b/c.dcm", "12345")], "path string, content string"), root).collect()
    assert [(r.key, r.size) for r in list_objects(spark, root).collect()] == [("a/b/c.dcm", 5)]


def test_daily_slice_is_one_calendar_day(spark):
    df = spark.range(96).select((F.lit("2024-01-13 12:00:00").cast("timestamp_ntz") + F.expr("make_dt_interval(0, id)")).alias("ts"))
    got = daily_slice(df, "ts", "2024-01-15", 1).agg(F.min("ts"), F.max("ts"), F.count("ts")).first()
    assert (str(got[0]), str(got[1]), got[2]) == ("2024-01-14 00:00:00", "2024-01-14 23:00:00", 24)
    assert daily_slice(df, "ts", "2024-01-15", 0).count() == 24
