"""One file per row, at the path the row names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.operators.skew import lookup_join
from lakeops.session import durable, forget, small_batches
from lakeops.sources.listing import place_of, walk_files
from lakeops.sources.store import Store, arrow_uri


class DuplicatePaths(ValueError):
    """Two rows would become the same file."""


def require_unique_paths(files: DataFrame) -> None:
    doubled = files.groupBy("path").count().where("count > 1").limit(1).collect()
    if doubled:
        raise DuplicatePaths(f"{doubled[0]['count']} rows for the file {doubled[0].path}")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write ``content`` (string or binary) of each row to ``root/path``; returns ``(path, n_bytes)``.

    Tasks write to the storage directly. A file is written under a temporary name and renamed, so a
    task that is run again after a lost executor ends with the same file. Temporary names start with a
    dot, which every listing leaves out, and are removed when a write fails. A batch of files is bounded in bytes.
    """
    small_batches(files.sparkSession)
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(arrow_uri(root))
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for path, content in zip(batch["path"], batch["content"]):
                data = content.encode("utf-8") if isinstance(content, str) else bytes(content)
                final = f"{base}/{path}"
                folder = final.rsplit("/", 1)[0]
                if folder not in made:
                    target.create_dir(folder, recursive=True)
                    if len(made) > 10_000:
                        made.clear()
                    made.add(folder)
                partial = f"{folder}/.{uuid.uuid4().hex}.partial"
                try:
                    with target.open_output_stream(partial) as stream:
                        stream.write(data)
                    target.move(partial, final)
                except Exception:
                    if target.get_file_info(partial).type != fs.FileType.NotFound:
                        target.delete_file(partial)
                    raise
                sizes.append(len(data))
            yield pd.DataFrame({"path": batch["path"], "n_bytes": sizes})

    return files.select("path", "content").mapInPandas(write, "path string, n_bytes bigint")


def remove_files(files: DataFrame) -> DataFrame:
    """Delete the files of a listing (``path``) by tasks, and folders that this leaves empty; returns ``(path)``.
    A file that is gone already is no error, so a task may run again."""
    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch["path"]:
                where, path, _ = place_of(uri)
                if where.get_file_info(path).type == fs.FileType.NotFound:
                    continue
                where.delete_file(path)
                folder = path.rsplit("/", 1)[0]
                if not where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                    try:
                        where.delete_dir(folder)
                    except FileNotFoundError:  # another task was faster
                        pass
            yield batch

    return files.select("path").mapInPandas(remove, "path string")


def replace_day_folders(files: DataFrame, root: str, day_folders: list[str]) -> dict[str, int]:
    """Write the files of some days, then remove what else lies in the folders of those days.

    Files are put in place one by one, each whole, before anything is removed; what is removed is the
    listing of the folders less what this run has written. Stopped at any point, a run has lost nothing:
    every file is the old or the new one, and the next run finishes. The folders are shared by every kind
    of file of a day. ``files`` must be materialized: its paths are checked before anything is written.
    """
    require_unique_paths(files)
    store = Store(files.sparkSession)
    done = durable(write_files(files, root))
    folders = [f"{root.rstrip('/')}/{f}" for f in day_folders]
    folders = [f for f in folders if store.exists(f)]
    if folders:
        base = store.qualified(root).rstrip("/")
        found = walk_files(files.sparkSession, folders, hidden=True)  # drafts of runs that were stopped go too
        kept = done.select(F.concat(F.lit(f"{base}/"), F.col("path")).alias("path"))
        remove_files(lookup_join(found.select("path"), kept, ["path"], "left_anti")).write.format("noop").mode("overwrite").save()
    total = done.agg(F.count(F.lit(1)).alias("files"), F.sum("n_bytes").alias("n_bytes")).first()
    forget(done)
    return {"files": total.files, "n_bytes": total.n_bytes or 0}
