"""Folder-level operations on whatever file system a path lives on.

Only metadata passes through here (listing partition folders, renaming, deleting); file contents are
read and written by tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    is_dir: bool
    size: int


class Store:
    """Thin access to the Hadoop file system API of the session."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _resolve(self, path: str):
        handle = self._jvm.org.apache.hadoop.fs.Path(path)
        return handle.getFileSystem(self._conf), handle

    def qualified(self, path: str) -> str:
        """The path with its scheme, as a Hadoop URI without escapes."""
        fs, handle = self._resolve(path)
        return fs.makeQualified(handle).toString()

    def exists(self, path: str) -> bool:
        fs, handle = self._resolve(path)
        return fs.exists(handle)

    def children(self, path: str) -> list[Entry]:
        """Direct children of a folder, sorted by name; empty when the folder is absent."""
        fs, handle = self._resolve(path)
        if not fs.exists(handle):
            return []
        found = [
            Entry(s.getPath().toString(), s.getPath().getName(), s.isDirectory(), s.getLen())
            for s in fs.listStatus(handle)
        ]
        return sorted(found, key=lambda e: e.name)

    def total_bytes(self, path: str) -> int:
        fs, handle = self._resolve(path)
        return fs.getContentSummary(handle).getLength()

    def make_dirs(self, path: str) -> None:
        fs, handle = self._resolve(path)
        fs.mkdirs(handle)

    def delete(self, path: str) -> bool:
        fs, handle = self._resolve(path)
        return fs.delete(handle, True)

    def rename(self, source: str, target: str) -> None:
        fs, handle = self._resolve(source)
        if not fs.rename(handle, self._jvm.org.apache.hadoop.fs.Path(target)):
            raise OSError(f"could not rename {source} to {target}")

    def read_text(self, path: str) -> str:
        """A small text file."""
        fs, handle = self._resolve(path)
        stream = fs.open(handle)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Put a small text file in place, whole or not at all; one that exists already is an error."""
        fs, handle = self._resolve(path)
        if fs.exists(handle):
            raise FileExistsError(path)
        folder, _, name = path.rpartition("/")
        draft = self._jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}.draft")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fs.rename(draft, handle):
            raise OSError(f"could not write {path}")

    def recover(self, target: str) -> None:
        """Finish or undo a swap of ``target`` that was stopped half-way."""
        target = target.rstrip("/")
        aside = f"{target}__retired"
        if self.exists(aside):
            if self.exists(target):
                self.delete(aside)  # the new content was in place already
            else:
                self.rename(aside, target)

    def swap(self, target: str, staged: str) -> None:
        """Put the folder ``staged`` in the place of ``target``.

        Old content is set aside first and dropped last. Stopped in between, ``recover`` puts the old
        content back, or drops it if the new is in place; whoever reads ``target`` to change it calls
        that first. Readers meet a moment without the table, so tables that must never be missing
        belong in ``VersionedTables``.
        """
        target = target.rstrip("/")
        self.recover(target)
        aside = f"{target}__retired"
        existed = self.exists(target)
        if existed:
            self.rename(target, aside)
        else:
            self.make_dirs(target.rsplit("/", 1)[0])
        try:
            self.rename(staged, target)
        except Exception:
            self.recover(target)
            raise
        self.delete(aside)

    def partitions(self, path: str, column: str) -> list[str]:
        """Values of a ``column=value`` layout, ascending, read from folder names alone."""
        unescape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        prefix = f"{column}="
        return sorted(
            unescape(e.name[len(prefix):]) for e in self.children(path) if e.is_dir and e.name.startswith(prefix)
        )


def arrow_uri(path: str) -> str:
    """A path as tasks hand it to Arrow's file systems, which know S3 by another scheme."""
    scheme, found, rest = path.partition("://")
    if not found:
        return f"file://{path.removeprefix('file:')}"
    return f"s3://{rest}" if scheme in ("s3a", "s3n") else path
