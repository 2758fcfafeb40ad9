"""One JSON file for each document with zones, written by Spark at the path that mirrors the document's own.

Tasks write to a staging folder under the root. When all have ended, the files of the attempts that count are
moved to their places; when the job fails, the staging folder goes, so that nothing of it stays. Of rows of equal path one stays.
The root may be a path or a URI of a store that pyarrow knows.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "zone_files"
#: Files that the driver moves at a time.
_AT_ONCE = 16


def _store(root: str):  # noqa: ANN202
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (LocalFileSystem(), posixpath.abspath(root))


@dataclass
class Written(WriterCommitMessage):
    """Where a task's attempt left its files, and the list of them."""

    folder: str
    n: int


class ZoneFileWriter(DataSourceWriter):
    """Writes rows of (zone_path, file, path, zones, relevant_text): all but zone_path become the file."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def _staging(self, top: str) -> str:
        return posixpath.join(top, f".staging-{self.job}")

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, top = _store(self.root)
        folder = posixpath.join(self._staging(top), uuid.uuid4().hex)
        fs.create_dir(folder, recursive=True)
        n = 0
        with fs.open_output_stream(posixpath.join(folder, "list")) as places:
            for row in iterator:
                held = row.asDict(recursive=True)
                place = held.pop("zone_path").split("://")[-1].lstrip("/")
                if ".." in place.split("/"):
                    raise ValueError(f"{place} leaves the root")
                with fs.open_output_stream(posixpath.join(folder, str(n))) as f:
                    f.write(json.dumps(held, ensure_ascii=False, indent=4).encode())
                places.write(json.dumps(place).encode() + b"\n")
                n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = _store(self.root)
        staging = self._staging(top)
        kept = set()
        if self.overwrite:
            from pyarrow.fs import FileSelector, FileType

            for x in fs.get_file_info(FileSelector(top, allow_not_found=True)):
                if not x.base_name.startswith(".staging-"):
                    (fs.delete_dir if x.type == FileType.Directory else fs.delete_file)(x.path)
        with ThreadPoolExecutor(_AT_ONCE) as pool:
            for m in messages:
                if m is None:
                    continue
                with fs.open_input_stream(posixpath.join(m.folder, "list")) as f:
                    places = [json.loads(x) for x in f.read().splitlines()]
                for folder in {posixpath.dirname(p) for p in places} - kept:
                    fs.create_dir(posixpath.join(top, folder), recursive=True)
                    kept.add(folder)
                list(pool.map(lambda ip, at=m.folder: fs.move(posixpath.join(at, str(ip[0])), posixpath.join(top, ip[1])), enumerate(places)))
        fs.delete_dir(staging) if any(m is not None for m in messages) else None

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        fs, top = _store(self.root)
        if fs.get_file_info(self._staging(top)).type == FileType.Directory:
            fs.delete_dir(self._staging(top))


class ZoneFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ZoneFileWriter:
        missing = {"zone_path", "file", "path", "zones", "relevant_text"} - set(schema.names)
        if missing:
            raise ValueError(f"zone files need the columns {sorted(missing)}")
        return ZoneFileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZoneFiles)
