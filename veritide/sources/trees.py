"""Source trees as a data source of Spark: ``spark.read.format("source_tree").load(folder)``.

The driver lists folders from the top only until there are enough of them to share out; each
partition is a folder that an executor lists and reads, so no list of files crosses the
driver. Folders that the gates or a filter on ``path`` rule out are never listed, and files
that a filter on name, extension or size rules out are never opened.

Options: ``ignored`` (globs, one a line, of names and paths that are left out, instead of the
usual ones), ``folders`` (how many folders to share out at least), ``content`` (``false``
leaves the texts unread), ``most`` (the largest size that is read, in bytes). Pushed filters need
``spark.sql.python.filterPushdown.enabled``. Folders are addressed as Arrow does (local paths,
hdfs, s3, gs and the like); for other schemes there is ``files.scan``.

Defined results: files that aren't UTF-8 are read without what isn't; a file that goes while it
is read, or that can't be read, has null content and hash; links to folders above are followed
once at most; an empty folder gives no rows.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

SCHEMA = "path string, name string, ext string, size long, last_modified timestamp, hash string, content string"
TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, StringStartsWith: lambda x, v: x.startswith(v),
}
KNOWN = ("path", "name", "ext", "size")  # what is known of a file before it is opened


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


def suffix(name: str) -> str:
    return "." + name.rsplit(".", 1)[1].lower() if "." in name.lstrip(".")[:-1] and name.rsplit(".", 1)[0] else ""


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], ignored: list[str]):
        self.root = options["path"].rstrip("/")
        self.ignored = options["ignored"].split("\n") if "ignored" in options else ignored
        self.folders, self.most = int(options.get("folders", 64)), int(options.get("most", 1 << 62))
        self.content = options.get("content", "true").lower() != "false"
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in TESTS and column in KNOWN:
                self.filters.append((column, type(f), f.value))
            else:
                yield f

    # Gates

    def left_out(self, path: str, name: str) -> bool:
        return any(fnmatch.fnmatchcase(name, p) or fnmatch.fnmatchcase(path, p) for p in self.ignored)

    def may_hold(self, folder: str) -> bool:
        """Whether a folder ("a/b") can have a file whose path passes."""
        for column, kind, value in self.filters:
            if column == "path" and kind in (EqualTo, StringStartsWith, In):
                values = value if kind is In else (value,)
                inside = [v for v in values if isinstance(v, str) and (v.startswith(f"{folder}/") or kind is StringStartsWith and f"{folder}/".startswith(v))]
                if not inside:
                    return False
        return True

    def passes(self, known: dict) -> bool:
        return known["size"] <= self.most and all(TESTS[kind](known[column], value) for column, kind, value in self.filters)

    # Listing

    def files(self):
        from pyarrow import fs

        if self.root.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.root[5:].lstrip("/")
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def entries(self, files, base: str, folder: str) -> tuple[list[str], list]:
        """Folders and files right below a folder that the gates let through."""
        from pyarrow import fs

        found = sorted(files.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)), key=lambda x: x.base_name)
        within = lambda x: f"{folder}/{x.base_name}".lstrip("/")
        kept = [(within(x), x) for x in found if not self.left_out(within(x), x.base_name)]
        return [p for p, x in kept if x.type == fs.FileType.Directory and self.may_hold(p)], [(p, x) for p, x in kept if x.type == fs.FileType.File]

    def partitions(self) -> list[Folder]:
        files, base = self.files()
        flat, open_folders = [], [""]
        # Level by level, so many folders are found by few listings; a level without folders ends it.
        while open_folders and len(open_folders) < self.folders:
            below = [p for folder in open_folders for p in self.entries(files, base, folder)[0]]
            flat += [Folder(p, False) for p in open_folders]
            open_folders = below
        return flat + [Folder(p, True) for p in open_folders]

    def read(self, partition: Folder) -> Iterator[tuple]:
        files, base = self.files()
        waiting = [partition.path]
        while waiting:
            folder = waiting.pop()
            below, found = self.entries(files, base, folder)
            if partition.deep:
                waiting += below[::-1]
            for path, info in found:
                name = info.base_name
                known = {"path": path, "name": name, "ext": suffix(name), "size": info.size}
                if self.passes(known):
                    data = self.opened(files, info.path) if self.content else None
                    text = None if data is None else data.decode("utf-8", "ignore")
                    yield path, name, known["ext"], info.size, info.mtime, None if data is None else hashlib.sha256(data).hexdigest(), text

    def opened(self, files, path: str) -> bytes | None:
        try:
            with files.open_input_stream(path, compression=None) as f:
                return f.readall()
        except OSError:
            return None


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        from veritide.sources.files import IGNORED

        return TreeReader(self.options, IGNORED)


#: Schemes that Arrow's file systems know.
SCHEMES = ("", "file", "hdfs", "s3", "gs", "gcs", "abfs")


def with_bytes(files, root: str):
    """``files`` (path below ``root``, and others) with ``data``: what is in them, read where the rows are."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructType

    at = files.columns.index("path")
    reader = TreeReader({"path": root}, [])

    def run(batches):
        own, base = reader.files()
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time is in memory
                path = f"{base}/{batch.column(at)[k].as_py()}"
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns), pa.array([reader.opened(own, path)], pa.binary())], [*batch.schema.names, "data"])

    return files.mapInArrow(run, StructType([*files.schema.fields]).add("data", BinaryType()))


def register(spark) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
