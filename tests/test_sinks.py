import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.operators.documents import parse_documents
from lakeops.operators.maintenance import compact, drop_old_versions, retained_versions
from lakeops.plans.document_job import run_document_job
from lakeops.sinks.bulk import Shared, read_bulk, write_bulk
from lakeops.sinks.refresh import refresh_tables, to_declared
from lakeops.sinks.release import (
    check_version, dictionary_bucket, output_path, publish_release, release_path, release_table, release_version,
)
from lakeops.sinks.tree import DuplicatePaths, replace_day_folders, require_unique_paths
from lakeops.sinks.upsert import upsert_files, DuplicateKeys, insert_ignore, upsert
from lakeops.sinks.window import overwrite_window
from lakeops.sources.files import list_objects
from lakeops.sources.registry import Dataset, Registry, Storage
from lakeops.sources.store import Store
from lakeops.sources.tables import partitioned_table


def days(spark, *rows):
    return spark.createDataFrame([(f"2024-01-{d:02d}", v) for d, v in rows], "day string, v string")


def content(spark, path):
    return sorted((r.day[-2:], r.v) for r in partitioned_table(spark, path, "day").collect())


def test_window_overwrite_replaces_exactly_the_window(spark, fresh):
    path = fresh()
    overwrite_window(days(spark, (1, "a"), (2, "a"), (3, "a"), (4, "a")), path, "day", "2024-01-01", "2024-01-31")
    new = days(spark, (2, "b"))  # the third has vanished
    for rebalance in (False, True):  # and again: the same result
        assert overwrite_window(new, path, "day", "2024-01-02", "2024-01-04", rebalance) == 1
        assert content(spark, path) == [("01", "a"), ("02", "b"), ("04", "a")]


def test_window_overwrite_rejects_bad_input_and_changes_nothing(spark, fresh):
    path = fresh()
    overwrite_window(days(spark, (1, "a"), (2, "a")), path, "day", "2024-01-01", "2024-01-31")
    with pytest.raises(ValueError, match="would become empty"):
        overwrite_window(days(spark, (1, "x")).where("v = ''"), path, "day", "2024-01-01", "2024-01-02")
    with pytest.raises(ValueError, match="differ in columns"):
        overwrite_window(days(spark, (1, "x")).withColumn("w", F.lit(1)), path, "day", "2024-01-01", "2024-01-02")
    with pytest.raises(Exception, match="outside the window"):
        overwrite_window(days(spark, (1, "x"), (9, "x")), path, "day", "2024-01-01", "2024-01-02")
    with pytest.raises(ValueError, match="empty window"):
        overwrite_window(days(spark, (1, "x")), path, "day", "2024-01-02", "2024-01-02")
    assert content(spark, path) == [("01", "a"), ("02", "a")]


def people(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def test_upsert_updates_inserts_and_keeps(spark):
    target = people(spark, [(1, "a", "n", "old"), (2, "b", "n", "old"), (None, "z", "n", "old")], "id int, name string, note string, created_at string")
    staging = people(spark, [(2, "B", "new"), (3, "C", "new"), (None, "N", "new"), (None, "M", "new")], "id int, name string, created_at string")
    got = sorted(map(tuple, upsert(target, staging, ["id"], ["created_at"]).collect()), key=str)
    assert got == sorted([
        (1, "a", "n", "old"), (2, "B", "n", "old"), (None, "z", "n", "old"),
        (3, "C", None, "new"), (None, "N", None, "new"), (None, "M", None, "new"),
    ], key=str)


def test_upsert_can_set_a_column_to_null(spark):
    target = people(spark, [(1, "a")], "id int, name string")
    staging = people(spark, [(1, None)], "id int, name string")
    assert upsert(target, staging, ["id"]).collect() == [(1, None)]


def test_upsert_rejects_two_rows_for_one_key(spark):
    target = people(spark, [(1, "a")], "id int, name string")
    with pytest.raises(DuplicateKeys, match="'id': 7"):
        upsert(target, people(spark, [(7, "x"), (7, "y")], "id int, name string"), ["id"])


def test_upsert_without_update_columns_ignores_known_keys(spark):
    target = people(spark, [(1, "a", "old")], "id int, name string, created_at string")
    staging = people(spark, [(1, "new"), (2, "new")], "id int, created_at string")
    got = sorted(map(tuple, upsert(target, staging, ["id"], ["created_at"]).collect()))
    assert got == [(1, "a", "old"), (2, None, "new")]
    rows = people(spark, [(5, "second", 1), (5, "first", 0)], "id int, name string, n int")
    added = insert_ignore(target, rows, ["id"], ["n"]).where("id = 5").collect()
    assert [r.name for r in added] == ["first"]


def test_refresh_replaces_all_tables_or_none(spark, fresh):
    root = fresh()
    one, two, three = (spark.createDataFrame([(i,)], "v int") for i in (1, 2, 3))
    tables = refresh_tables(spark, root, {"a": one, "b": one})
    broken = spark.range(1).select(F.raise_error(F.lit("source is broken")).cast("int").alias("v"))
    with pytest.raises(Exception, match="source is broken"):
        refresh_tables(spark, root, {"a": two, "b": broken})
    assert [tables.read(n).first().v for n in "ab"] == [1, 1]
    refresh_tables(spark, root, {"a": two, "b": three})
    assert [tables.read(n).first().v for n in "ab"] == [2, 3]
    refresh_tables(spark, root, {"b": one})
    assert [tables.read(n).first().v for n in "ab"] == [2, 1] and tables.names() == ["a", "b"]


def test_a_change_that_is_not_committed_has_not_happened(spark, fresh):
    root = fresh()
    tables = refresh_tables(spark, root, {"a": spark.createDataFrame([(1,)], "v int")})
    left = tables.begin()
    spark.createDataFrame([(2,)], "v int").write.parquet(tables.folder(left, "a"))  # and then it stops
    assert tables.read("a").first().v == 1
    assert tables.begin() > left
    for v in (3, 4, 5):
        refresh_tables(spark, root, {"a": spark.createDataFrame([(v,)], "v int")})
    assert tables.read("a").first().v == 5
    assert len(Store(spark).children(f"{root}/_states")) == 2


@pytest.mark.parametrize("stopped_before", ["set aside", "put in place", "clean up"])
def test_a_stopped_swap_loses_nothing(spark, fresh, monkeypatch, stopped_before):
    root, store = fresh(), Store(spark)
    for name in ("t", "t_new"):
        spark.createDataFrame([(name,)], "v string").write.parquet(f"{root}/{name}")

    class Stopped(BaseException):
        pass

    def stop(*_):
        raise Stopped

    with monkeypatch.context() as m:
        if stopped_before == "set aside":
            m.setattr(store, "rename", stop)
        elif stopped_before == "put in place":
            rename = store.rename
            m.setattr(store, "rename", lambda a, b: stop() if a.endswith("t_new") else rename(a, b))
        else:
            m.setattr(store, "delete", stop)
        with pytest.raises(Stopped):
            store.swap(f"{root}/t", f"{root}/t_new")
    store.recover(f"{root}/t")
    assert spark.read.parquet(f"{root}/t").first().v == ("t_new" if stopped_before == "clean up" else "t")
    assert [e.name for e in store.children(root) if "retired" in e.name] == []


def test_a_failed_swap_puts_the_table_back(spark, fresh):
    root = fresh()
    store = Store(spark)
    spark.createDataFrame([("t",)], "v string").write.parquet(f"{root}/t")
    with pytest.raises(Exception):
        store.swap(f"{root}/t", f"{root}/nowhere")
    assert spark.read.parquet(f"{root}/t").first().v == "t"


def test_declared_columns_come_from_the_header(spark):
    schema = T.StructType().add("id", "long").add("note", "string")
    got = to_declared(spark.createDataFrame([("4",)], "id string"), schema)
    assert got.schema == schema and got.collect() == [(4, None)]
    with pytest.raises(ValueError, match="other"):
        to_declared(spark.createDataFrame([("4",)], "other string"), schema)


def tree(spark, rows):
    return spark.createDataFrame(rows, "path string, day string, content string")


def test_trees_are_replaced_by_day(spark, fresh):
    root = fresh()
    first = tree(spark, [("t/2024/01/01/A/report.md", "d", "é"), ("t/2024/01/01/B/report.md", "d", "b"), ("t/2024/01/02/A/report.md", "d", "a")])
    replace_day_folders(first, root, ["t/2024/01/01", "t/2024/01/02"])
    again = tree(spark, [("t/2024/01/01/A/report.md", "d", "new")])
    for _ in range(2):
        assert replace_day_folders(again, root, ["t/2024/01/01"]) == {"files": 1, "n_bytes": 3}
        got = sorted((r.key, r.size) for r in list_objects(spark, root).collect())
        assert got == [("t/2024/01/01/A/report.md", 3), ("t/2024/01/02/A/report.md", 1)]


def test_a_tree_that_is_stopped_has_lost_nothing(spark, fresh, monkeypatch):
    from lakeops.sinks import tree as sink

    root = fresh()
    old = tree(spark, [(f"t/2024/01/0{d}/{k}/report.md", "d", f"old {k}") for d in (1, 2) for k in "ABC"])
    replace_day_folders(old, root, ["t/2024/01/01", "t/2024/01/02"])
    new = tree(spark, [(f"t/2024/01/01/{k}/report.md", "d", f"new {k}") for k in "BCD"])

    def listed():
        return {r.key: open(f"{root}/{r.key}").read() for r in list_objects(spark, root).collect()}

    before = listed()
    for step in ("write_files", "remove_files"):
        def stop(*_):
            raise RuntimeError("stopped")

        with monkeypatch.context() as m:
            m.setattr(sink, step, stop)
            with pytest.raises(RuntimeError, match="stopped"):
                replace_day_folders(new, root, ["t/2024/01/01"])
        assert before.keys() <= listed().keys()
    drafts = f"{root}/t/2024/01/01/A/.left-over.partial"
    open(drafts, "w").write("half")
    assert replace_day_folders(new, root, ["t/2024/01/01"]) == {"files": 3, "n_bytes": 15}
    want = {f"t/2024/01/01/{k}/report.md": f"new {k}" for k in "BCD"} | {k: v for k, v in before.items() if "/01/02/" in k}
    assert listed() == want
    import os
    assert not os.path.exists(f"{root}/t/2024/01/01/A") and os.listdir(f"{root}/t/2024/01/01/B") == ["report.md"]
    replace_day_folders(new.limit(0), root, ["t/2024/01/01", "t/2024/01/09"])
    assert listed() == {k: v for k, v in before.items() if "/01/02/" in k}


def test_trees_refuse_two_rows_for_one_file(spark, fresh):
    root = fresh()
    replace_day_folders(tree(spark, [("t/1/A", "d", "x")]), root, ["t/1"])
    with pytest.raises(DuplicatePaths):
        replace_day_folders(tree(spark, [("t/1/A", "d", "x"), ("t/1/A", "d", "y")]), root, ["t/1"])
    assert list_objects(spark, root).count() == 1  # nothing was cleared
    require_unique_paths(tree(spark, [("a", "d", "x"), ("b", "d", "x")]))


def test_versions():
    assert release_version("latest", "2024-02-02T03:00", pass_date=True) == "2024-02-02"
    assert release_version("latest", "2024-02-02", pass_date=False) == "latest"
    assert release_version("2024-01-05", "2024-02-02", pass_date=True, underscore=True) == "2024_01_05"
    for bad in ("", "05-01-2024", "newest"):
        with pytest.raises(ValueError, match="YYYY-MM-DD"):
            check_version(bad)


def test_output_paths(spark):
    def path(template, bucket):
        return spark.range(1).select(output_path(F.lit(template), F.lit("2024-02-02"), F.lit(bucket), "open-shelf")).first()[0]

    assert path("/shop/{{version}}/t_{{version}}", "open-shelf") == "published/shop/2024-02-02/t_2024_02_02"
    assert path("/shop/{{version}}/t_{{version}}", "other") == "/shop/2024-02-02/t_2024_02_02"
    assert dictionary_bucket(["a-nominative", "b-clinical"], "open-shelf") == "b-clinical"
    assert dictionary_bucket(["a-nominative"], "open-shelf") == "a-nominative"
    assert dictionary_bucket([], "open-shelf") == "open-shelf"


def test_publishing_cleans_and_names_tables(spark, fresh):
    base, out = fresh(), fresh()
    release_table(spark.createDataFrame([(1, "a\x01b")], "k int, v string"), base, "shop", "2024-02-02", "t")
    assert release_path(base, "shop", "2024-02-02", "t").endswith("/released/shop/2024-02-02/t")
    registry = Registry([Storage("g", "s3a://open-shelf")], [Dataset("published_shop_t", "g", "/shop/{{version}}/t_{{version}}")])
    plan = publish_release(spark, registry, base, "shop", "2024-02-02", out, "open-shelf").collect()
    assert [(p.bucket, p.path) for p in plan] == [("open-shelf", "published/shop/2024-02-02/t_2024_02_02.csv")]
    rows = spark.read.option("header", True).csv(f"{out}/open-shelf/{plan[0].path}").collect()
    assert [(r.k, r.v) for r in rows] == [("1", "ab")]


def test_bulk_chunks_keep_the_order_of_ids(spark, fresh):
    path = fresh()
    docs = spark.range(0, 1000).select((F.lit(999) - F.col("id")).alias("doc_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00.123456'").alias("t"))
    chunks = write_bulk(docs.repartition(7), path, "doc_id", chunk=300).orderBy("first_ordinal").collect()
    got = read_bulk(spark, path).orderBy("ordinal").collect()
    lines = [json.loads(r.line) for r in got]
    assert [x["_id"] for x in lines] == [str(i) for i in range(1000)] and [r.ordinal for r in got] == list(range(1000))
    assert [r.chunk for r in got] == [i // 300 for i in range(1000)]
    assert lines[0]["_source"] == {"doc_id": 0, "t": "2024-01-01T00:00:00.123456"}
    # Ranges of chunks are gapless, and files are as many as the sort has partitions, not as chunks.
    assert [c.first_ordinal + c.n for c in chunks] == [*[c.first_ordinal for c in chunks[1:]], 1000]
    assert [(c.first_id, c.last_id) for c in chunks] == [(str(c.first_ordinal), str(c.first_ordinal + c.n - 1)) for c in chunks]
    small = write_bulk(docs.repartition(7), path, "doc_id", chunk=3)
    assert small.select("chunk").distinct().count() == 334
    assert len([r for r in list_objects(spark, f"{path}/data").collect()]) <= 4


def test_bulk_that_fails_leaves_what_was_there(spark, fresh):
    path = fresh()
    good = spark.range(20).withColumnRenamed("id", "doc_id")
    write_bulk(good, path, "doc_id")
    with pytest.raises(ValueError, match="share the id '7'"):
        write_bulk(good.unionByName(good.where("doc_id = 7")), path, "doc_id")
    assert read_bulk(spark, path).count() == 20
    folder, name = path.rsplit("/", 1)
    assert [r.key for r in list_objects(spark, folder).where(F.col("key").contains("staged")).collect()] == []
    write_bulk(good.limit(0), path, "doc_id")
    assert read_bulk(spark, path).count() == 0


def _told_apart(spark, sources, parts):
    """Sources of few sets: every seventh has none, every eleventh one that is unknown."""
    key = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, 99).otherwise(F.col("id") % 3).cast("int")
    heads = spark.range(sources).select(
        F.col("id").alias("doc_id"), F.concat(F.lit('a "b"\n\\'), F.col("id").cast("string")).alias("text"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00.123456'").alias("t"), F.when(F.col("id") % 2 == 0, "é").alias("opt"), key.alias("set_id"))
    pieces = spark.range(3 * parts).select(
        (F.col("id") % 3).cast("int").alias("set_id"), F.floor(F.col("id") / 3).cast("int").alias("part"),
        F.struct(F.array(F.lit('","_source":{'), F.repeat(F.lit("x"), 300), F.col("id").cast("string")).alias("codes")).alias("held"))
    return heads, pieces


def test_documents_of_shared_pieces_are_those_written_whole(spark, fresh):
    heads, pieces = _told_apart(spark, 60, 40)
    whole, apart = fresh(), fresh()
    docs = heads.join(pieces, "set_id", "left").fillna(0, ["part"]).drop("set_id")
    a = write_bulk(docs, whole, "doc_id", chunk=17)
    b = write_bulk(heads.repartition(5), apart, "doc_id", chunk=17, shared=Shared(pieces.repartition(3), "set_id"))

    def chunks(table):
        return sorted((r.chunk, r.n, r.first, r.low, r.high) for r in table.groupBy("chunk").agg(
            F.sum("n").alias("n"), F.min("first_ordinal").alias("first"), F.min_by("first_id", "first_ordinal").alias("low"), F.max_by("last_id", "first_ordinal").alias("high")).collect())

    assert chunks(a) == chunks(b)
    want, got = (sorted(map(tuple, read_bulk(spark, p).collect())) for p in (whole, apart))
    assert got == want and len(got) == docs.count() > 1500


def test_shared_pieces_are_written_once(spark, fresh):
    def written(sources, parts):
        heads, pieces = _told_apart(spark, sources, parts)
        path = fresh()
        write_bulk(heads, path, "doc_id", chunk=30, shared=Shared(pieces, "set_id"))
        assert read_bulk(spark, path).count() > sources * parts // 2
        return sum(r.size for name in ("data", "shared") for r in list_objects(spark, f"{path}/{name}").collect())

    once, twice = written(100, 50), written(200, 100)  # four times as many documents
    assert twice < 2.2 * once


def test_shared_pieces_that_are_not_whole_or_come_twice_are_an_error(spark, fresh):
    heads, pieces = _told_apart(spark, 20, 5)
    path = fresh()
    for some, more, told in ((heads, pieces.where("part <> 2"), "do not count from 0"), (heads, pieces.unionByName(pieces), "share the id"),
                             (heads.unionByName(heads), pieces, "share the id")):
        with pytest.raises(ValueError, match=told):
            write_bulk(some, path, "doc_id", shared=Shared(more, "set_id"))
    write_bulk(heads.limit(0), path, "doc_id", shared=Shared(pieces, "set_id"))
    assert read_bulk(spark, path).count() == 0


@pytest.mark.parametrize("partition", [None, "k"])
def test_an_upsert_rewrites_the_files_it_touches(spark, fresh, partition):
    import os

    path = fresh()
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("kept")).repartitionByRange(8, "id")
    (rows.write.partitionBy(partition) if partition else rows.write).parquet(path)
    plain = spark.read.parquet(path).select("id", "k", "v", "kept")
    staging = spark.createDataFrame([(3, 1, "new"), (60, 0, "new"), (1000, 1, "new"), (None, 0, "new")], "id long, k int, v string")
    want = sorted(map(tuple, upsert(plain, staging, ["id"]).collect()), key=str)

    def files():
        return {k: os.stat(f"{path}/{k}").st_mtime_ns for k in data_files(spark, path)}

    before = files()
    done = upsert_files(spark, path, staging, ["id"], partition=partition)
    after = files()
    assert done["rewritten"] == 2 == len(before.keys() - after.keys())
    assert all(after[k] == t for k, t in before.items() if k in after) and len(before.keys() & after.keys()) == len(before) - 2
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "k", "v", "kept").collect()), key=str) == want
    # Rows that are new alone touch no file; a second run of the same staging changes no content.
    assert upsert_files(spark, path, staging.where("id = 1000").withColumn("id", F.lit(2000).cast("long")), ["id"], partition=partition)["rewritten"] == 0
    assert spark.read.parquet(path).count() == len(want) + 1


@pytest.mark.parametrize("step", ["rename", "delete"])
def test_a_stopped_upsert_is_completed(spark, fresh, monkeypatch, step):
    path = fresh()
    spark.range(100).select("id", F.lit("old").alias("v")).repartitionByRange(4, "id").write.parquet(path)
    staging = spark.createDataFrame([(5, "new"), (70, "new"), (500, "new")], "id long, v string")
    real = getattr(Store, step)

    def stop(self, source, *target):
        if "_compacting/data" in source or (step == "delete" and source.endswith(".parquet")):
            raise RuntimeError("stopped")
        return real(self, source, *target)

    with monkeypatch.context() as m:
        m.setattr(Store, step, stop)
        with pytest.raises(RuntimeError, match="stopped"):
            upsert_files(spark, path, staging, ["id"])
    upsert_files(spark, path, staging, ["id"])
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert spark.read.parquet(path).count() == 101 and {k for k, v in got.items() if v == "new"} == {5, 70, 500}


def numbered(spark, first, n, files, partition, path, mode="errorifexists"):
    rows = spark.range(first, first + n).select("id", (F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5)).cast("int").alias("k"))
    writer = rows.repartition(files).write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def data_files(spark, path):
    return {r.key for r in list_objects(spark, path).where("key LIKE '%.parquet'").collect()}


@pytest.mark.parametrize("partition", [None, "k"])
def test_compaction_keeps_content_and_large_files(spark, fresh, partition):
    path = fresh()
    numbered(spark, 0, 2000, 20, partition, path)
    before, many = sorted(spark.read.parquet(path).select("id", "k").collect()), len(data_files(spark, path))
    assert compact(spark, path, partition) == (5 if partition else 1)
    done = data_files(spark, path)
    assert len(done) == (5 if partition else 1) < many
    assert compact(spark, path, partition) == 0 and data_files(spark, path) == done
    assert sorted(spark.read.parquet(path).select("id", "k").collect()) == before
    numbered(spark, 2000, 20, 10, partition, path, "append")
    smallest = min(r.size for r in list_objects(spark, path).collect() if r.key in done)
    before = sorted(spark.read.parquet(path).select("id", "k").collect())
    compact(spark, path, partition, target_bytes=2 * smallest)  # the files of the first round are large by now
    assert done <= data_files(spark, path)
    assert sorted(spark.read.parquet(path).select("id", "k").collect()) == before


@pytest.mark.parametrize("stopped_at", range(4))
def test_a_stopped_compaction_is_completed(spark, fresh, monkeypatch, stopped_at):
    path = fresh()
    numbered(spark, 0, 500, 12, "k", path)
    before = sorted(spark.read.parquet(path).select("id", "k").collect())

    class Stopped(BaseException):
        pass

    steps = iter(range(1000))

    def stopping(original):
        def step(self, *args):
            if args[0].endswith("_compacting") or next(steps) != 3 * stopped_at:
                return original(self, *args)
            raise Stopped

        return step

    with monkeypatch.context() as m:
        m.setattr(Store, "rename", stopping(Store.rename))
        m.setattr(Store, "delete", stopping(Store.delete))
        with pytest.raises(Stopped):
            compact(spark, path, "k")
    compact(spark, path, "k")
    assert sorted(spark.read.parquet(path).select("id", "k").collect()) == before
    assert len(data_files(spark, path)) == 5


def test_old_versions_go_and_the_newest_always_stays(spark, fresh):
    path = fresh()
    rows = spark.createDataFrame([("t", f"2024-01-{d:02d}") for d in range(1, 13)] + [("u", "2023-01-01")], "name string, version string")
    rows.write.partitionBy("version").parquet(path)
    assert drop_old_versions(spark, path, "version", keep=10) == ["2023-01-01", "2024-01-01", "2024-01-02"]
    kept = {(r.name, r.version) for r in retained_versions(rows, "name", "version", keep=2).where("kept").collect()}
    assert kept == {("t", "2024-01-12"), ("t", "2024-01-11"), ("u", "2023-01-01")}
    dated = rows.withColumn("version", F.to_date("version"))
    young = {str(r.version) for r in retained_versions(dated, "name", "version", newest_age_days=1).where("kept").collect()}
    assert young == {"2024-01-12", "2024-01-11", "2023-01-01"}


@pytest.fixture
def parser():
    def make():
        def parse(doc, raw):
            if b"boom" in raw:
                raise RuntimeError("no")
            status = "partial_success" if b"half" in raw else "success"
            return {"status": status, "markdown": f"# {doc}", "tables": [("a,b\n1,2\n", 1, 2, 3), ("c\n", 0, 1, None)]}

        return parse

    return make


def test_the_document_job_end_to_end_and_again(spark, fresh, parser):
    source, report, root = fresh("src"), fresh("rep"), fresh("tree")
    docs = [("A/1", "%PDF-1.7 ok", "2024-01-01"), ("B", "%PDF-half", "2024-01-01"), ("C", "%PDF-boom", "2024-01-02"), ("D", "{\\rtf1", "2024-01-02"), ("E", "%PDF-x", "2024-01-09")]
    rows = spark.createDataFrame(docs, "hl7_id string, body string, dte_of_message string")
    rows = rows.withColumn("observation_value_base64", F.base64(F.encode("body", "UTF-8"))).drop("body")
    rows.write.partitionBy("dte_of_message").parquet(source)
    for tasks in (None, 3):
        counters = run_document_job(
            spark, source, report, root, "x/{{date}}/{{hl7_id}}/table_{{table_no}}.csv", "x/{{date}}/{{hl7_id}}/report.md",
            "2024-01-01", "2024-01-03", parser, tasks,
        )
        total = counters.where("dte_of_message IS NULL").first()
        assert (total.rows_read, total.pdfs_parsed, total.skipped, total.tables_extracted, total.reports_written, total.dates) == (4, 3, 1, 4, 2, 2)
        got = {r.hl7_id: (r.parse_status, r.parse_error) for r in partitioned_table(spark, report, "dte_of_message").collect()}
        assert got == {
            "A/1": ("success", None), "B": ("partial_success", None), "C": ("failure", "docling conversion failed"),
            "D": ("skipped", "unsupported format: rtf"),
        }
        keys = sorted(r.key for r in list_objects(spark, root).collect())
        assert keys == [f"x/2024/01/01/{d}/{f}" for d in ("A_1", "B") for f in ("report.md", "table_0.csv", "table_1.csv")]
    assert not Store(spark).exists(f"{root}/x/2024/01/09")


def test_no_parser_runs_for_skipped_documents(spark):
    def make():
        def parse(doc, raw):
            raise AssertionError("skipped documents must not be parsed")
        return parse

    rows = spark.createDataFrame([("a", "d", None, "rtf", "skipped", "unsupported format: rtf")],
                                 "hl7_id string, dte_of_message string, raw binary, source_format string, parse_status string, parse_error string")
    got = parse_documents(rows, make).first()
    assert (got.parse_status, got.report_markdown, got.tables) == ("skipped", None, [])


def test_copies_in_a_published_dictionary_take_little_room(spark, tmp_path):
    from pathlib import Path

    from lakeops.sinks.release import publish_dictionary

    rows = spark.range(0, 50_000, 1, 1).selectExpr("id DIV 1000 AS id", "'a label of some length' AS label")
    folder = publish_dictionary({"Value Sets": rows}, str(tmp_path), "africa", "2024-02-02", [], "open-shelf")
    files = [f for f in Path(folder, "value_sets").iterdir() if f.name.startswith("part-")]
    assert sum(f.stat().st_size for f in files) < 50_000
    back = spark.read.option("header", True).csv(f"{folder}/value_sets")
    assert {(r.id, r["count"]) for r in back.groupBy("id").count().collect()} == {(str(i), 1000) for i in range(50)}


def test_copies_of_a_folded_sheet_are_written_and_read_as_bytes(spark, tmp_path):
    """Every copy is in the files as Spark's reader sees them, and the folded reader counts all of them."""
    from pathlib import Path

    from lakeops.sinks.release import publish_dictionary, read_folded

    rows = spark.createDataFrame(
        [(1, 'a "b", c', 5000), (2, None, 1), (3, "", 300), (3, "", 2), (4, "é\\x", 9000), (None, " lead", 17), (5, "gone", 0)], "id int, label string, _times long").coalesce(1)
    plain = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).where("_times > 0").select("id", "label")
    one, two = (publish_dictionary({"Value Sets": df}, str(tmp_path / name), "africa", "2024-02-02", [], "open-shelf", "_times") for name, df in (("a", rows), ("b", plain)))

    def counted(folder):
        back = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/value_sets")
        return {(r.id, r.label): r["count"] for r in back.groupBy("id", "label").count().collect()}

    want = counted(two)
    assert counted(one) == want and sum(want.values()) == 14320
    for folder in (one, two):
        folded = read_folded(spark, f"{folder}/value_sets")
        assert {(r.id, r.label): r.n for r in folded.groupBy("id", "label").agg(F.sum("_times").alias("n")).collect()} == want
    assert read_folded(spark, f"{one}/value_sets").count() < 10
    assert all(f.name.endswith(".csv.gz") for f in Path(one, "value_sets").glob("part-*"))
    many = spark.createDataFrame([(i, 4_000_000) for i in range(5)], "id int, _times long")
    folder = publish_dictionary({"Value Sets": many, "Empty": many.limit(0)}, str(tmp_path / "c"), "africa", "2024-02-02", [], "open-shelf", "_times")
    found = read_folded(spark, f"{folder}/value_sets").groupBy("id").agg(F.sum("_times").alias("n")).collect()
    assert {(r.id, r.n) for r in found} == {(str(i), 4_000_000) for i in range(5)}
    assert read_folded(spark, f"{folder}/empty").columns == ["id", "_times"] and read_folded(spark, f"{folder}/empty").isEmpty()


def test_lines_are_counted_wherever_blocks_end():
    from lakeops.sinks.release import runs_of_lines

    lines = [b"a"] * 3 + [b"ab"] * 700 + [b"b,c"] + [b"aa"] * 50 + [b"x" * 300] * 2 + [b"z"]
    for end in (b"\n", b"\r\n", b"\r"):
        text = end.join(lines)
        for step in (1, 7, 64, 10_000):
            found = runs_of_lines(text[i:i + step] for i in range(0, len(text), step))
            assert [x for line, n in found for x in [line] * n] == lines


@pytest.mark.parametrize("block", [None, 1500])
def test_documents_are_folded_in_the_tasks_that_put_them_together(spark, fresh, monkeypatch, block):
    import pyarrow as pa

    from lakeops.sinks import bulk

    heads, pieces = _told_apart(spark, 60, 40)
    whole, apart = fresh(), fresh()
    write_bulk(heads.join(pieces, "set_id", "left").fillna(0, ["part"]).drop("set_id"), whole, "doc_id", chunk=17)
    write_bulk(heads, apart, "doc_id", chunk=17, shared=Shared(pieces, "set_id"))
    if block:  # documents are more than a block, and pieces more than a task holds
        monkeypatch.setattr(bulk, "_BLOCK", block)
        monkeypatch.setattr(bulk, "_HELD", block)

    def fold(blocks):
        for chunks, ordinal, text in blocks:
            lines = text.split(b"\n")
            assert len(lines) == len(chunks) and set(chunks) <= {x // 17 for x in range(ordinal, ordinal + len(lines))}
            yield pa.RecordBatch.from_pydict({"first": pa.array([ordinal], pa.int64()), "n": pa.array([len(lines)], pa.int64()), "text": [text.decode()]})

    want = [r.line for r in read_bulk(spark, whole).orderBy("ordinal").collect()]
    for path in (whole, apart):
        got = sorted(tuple(r) for r in bulk.fold_bulk(spark, path, fold, "first bigint, n bigint, text string").collect())
        assert [line for _, _, text in got for line in text.split("\n")] == want and (block or len(got) < len(want))
        assert sum(n for _, n, _ in got) == len(want)


@pytest.mark.parametrize("remembered", [1 << 26, 0])
def test_folded_variables_are_those_parsed_one_by_one(monkeypatch, remembered):
    import hashlib
    import json

    import numpy as np

    from lakeops.checks import dictionaries

    monkeypatch.setattr(dictionaries, "_REMEMBERED", remembered)
    sets = {1: [["b", "a"], [], [None, 'q",part":']], 2: [["b", "a"], ["z"], [None, 'q",part":']], None: [None], 3: [["a"]]}
    docs, want = [], []
    for var_id, key in enumerate([1, 1, 2, 1, None, 3, 2, 2]):
        name = None if var_id == 2 else f'v","part":{var_id}'
        first = len(docs)
        for part, codes in enumerate(sets[key]):
            value_set = None if codes is None else {"values": [{"vsval_code": c} for c in codes]}
            docs.append(json.dumps({"_id": f"{var_id}-{part}", "_source": {"var_id": var_id, "var_name": name, "part": part, "value_set": value_set}}, separators=(",", ":")).encode())
        every = [c for codes in sets[key] for c in codes or ()]
        digest = hashlib.md5(",".join(sorted(c for c in every if c is not None)).encode()).hexdigest()
        for chunk in sorted({x // 4 for x in range(first, len(docs))}):
            mine = [x for x in range(first, len(docs)) if x // 4 == chunk]
            want.append((chunk, var_id, name, len(mine), mine[0], len(every), digest))
    for step in (1, 2, 3, 5, len(docs)):
        blocks = ((np.arange(i, min(i + step, len(docs))) // 4, i, b"\n".join(docs[i:i + step])) for i in range(0, len(docs), step))
        got = [tuple(r.values()) for batch in dictionaries._fold_variables(blocks) for r in batch.to_pylist()]
        assert sorted(got) == sorted(want)
