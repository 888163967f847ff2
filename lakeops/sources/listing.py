"""Listing of folder trees by tasks.

Spark's own file index lists in tasks too, but gathers the status of every file in the driver. Here the
driver holds the roots and one number per round: tasks list folders, write what they find to shared
storage, and hand on the folders they have not entered.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.session import durable
from lakeops.sources.store import Store

#: Entries a task lists before it hands on the folders that are left.
BUDGET = 20_000
#: Rows of a batch that a task emits.
ROWS = 5_000


def place_of(uri: str):
    """Arrow's file system of a qualified URI, the path in it, and what goes before such a path in a URI."""
    from pyarrow import fs

    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    parts = urlsplit(uri)
    known = "s3" if scheme in ("s3a", "s3n") else scheme
    where, path = fs.FileSystem.from_uri(f"{known}://{parts.netloc}{quote(parts.path)}")
    return where, path, f"{scheme}://" if path.startswith(parts.netloc) else f"{scheme}://{parts.netloc}"


def is_hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _entered(found: deque, where, budget: int, hidden: bool) -> Iterator[tuple[str, int | None]]:
    """Files at and below the folders, as far as the budget goes; then the folders that are left, without a size."""
    from pyarrow import fs

    listed = 0
    while found:
        folder = found.popleft()
        if listed >= budget:
            yield folder, None
            continue
        for entry in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            listed += 1
            if not hidden and is_hidden(entry.base_name):
                continue
            if entry.type == fs.FileType.Directory:
                found.append(entry.path)
            elif entry.type == fs.FileType.File:
                yield entry.path, entry.size


def walk_files(spark: SparkSession, roots: str | list[str], glob: str | None = None, budget: int = BUDGET, hidden: bool = False) -> DataFrame:
    """``(path, size)`` of every file below the roots whose name fits ``glob`` (``*``, ``?``, ``[...]``).

    Rounds go on until no folder is left over; a task enters folders until it has listed ``budget`` entries,
    so small trees need one round and large ones are dealt out among ever more tasks. A task holds the
    listing of one folder at a time. Each round is a table on shared storage: what a lost executor listed
    is not listed twice. Names that Spark's readers leave out are left out unless ``hidden``. A root that does not exist is an error; a folder that vanishes on the way is empty.
    """
    store = Store(spark)
    uris = [store.qualified(r) for r in ([roots] if isinstance(roots, str) else roots)]
    for uri in uris:
        if not store.exists(uri):
            raise FileNotFoundError(uri)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            folders: dict[int, list[str]] = {}
            for root, path in zip(*(c.to_pylist() for c in batch.columns)):
                folders.setdefault(root, []).append(path)
            for root, paths in folders.items():
                where, _, before = place_of(uris[root])
                kinds = {info.path: info for info in where.get_file_info(paths)}
                rows = [(p, kinds[p].size) for p in paths if kinds[p].type == fs.FileType.File]  # a root may be a file

                def found():
                    names, sizes = zip(*((p if size is None else before + p, size) for p, size in rows)) if rows else ((), ())
                    return pa.RecordBatch.from_arrays(
                        [pa.array([root] * len(rows), pa.int32()), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["root", "path", "size"])

                queue = deque(p for p in paths if kinds[p].type != fs.FileType.File)
                for path, size in _entered(queue, where, budget, hidden):
                    if size is None or not glob or fnmatchcase(path.rsplit("/", 1)[-1], glob):
                        rows.append((path, size))
                    if len(rows) >= ROWS:
                        yield found()
                        rows = []
                yield found()

    tasks = spark.sparkContext.defaultParallelism * 4
    frontier = spark.createDataFrame([(i, place_of(u)[1]) for i, u in enumerate(uris)], "root int, path string")
    done = None
    while True:
        found = durable(frontier.repartition(tasks, "root", "path").mapInArrow(expand, "root int, path string, size bigint"))
        files = found.where("size IS NOT NULL").select("path", "size")
        done = files if done is None else done.unionByName(files)
        frontier = found.where("size IS NULL").select("root", "path")
        if frontier.isEmpty():
            return done
