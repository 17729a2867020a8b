"""Changes of a folder as a streaming source: ``spark.readStream.format("folder_changes")``.

Options: ``path`` (the folder, with all below it), ``manifest`` (a folder of the query's own that outlives it), ``pattern`` (of file
names, default ``*``), ``slices`` (tasks a batch, default 8). Rows: path, change (``new`` or ``modified``), length, modified.

An offset is the number of a listing that lies in the manifest; a batch is the difference of two listings. The first listing
only records what is there. A batch that is run again reads the same two listings, so it gives the same rows; after a
restart the stream goes on from the listing it had last committed, and what changed meanwhile is in its next batch. Listings
before that are removed. Signatures are length and modification time, as in ``files.changed``; removed files give no rows, a
file that comes back is new. An unchanged folder makes no listing. A listing goes through the driver, as for
every file source.

Defined cases: an empty or missing folder is an empty listing; empty files have length 0; names may hold blanks and any
letters. One query a manifest: two would remove each other's listings.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "folder_changes"
SCHEMA = "path string, change string, length long, modified timestamp"


def _opened(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path on it, and what stands before its paths in the URI."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.rstrip("/"), ""
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path.rstrip("/"), uri.split(":", 1)[0] + "://" if "://" in uri else "file:"


def listed(folder: str, pattern: str) -> dict[str, list[int]]:
    """Length and time (microseconds) by path."""
    system, base, before = _opened(folder)
    found = system.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    fitting = (f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern))
    return {before + f.path: [f.size, f.mtime_ns // 1000] for f in fitting}


class Manifest:
    """Numbered listings in a folder. A listing is written under another name first, so no half-written one is read."""

    def __init__(self, folder: str) -> None:
        self.system, self.base, _ = _opened(folder)
        self.system.create_dir(self.base, recursive=True)

    def versions(self) -> list[int]:
        found = self.system.get_file_info(pafs.FileSelector(self.base))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def path(self, version: int) -> str:
        return f"{self.base}/{version:012d}.json"

    def read(self, version: int) -> dict[str, list[int]]:
        with self.system.open_input_stream(self.path(version)) as stream:
            return json.loads(stream.read())

    def add(self, version: int, listing: dict[str, list[int]]) -> None:
        part = f"{self.base}/{version:012d}.part"
        with self.system.open_output_stream(part) as stream:
            stream.write(json.dumps(listing, ensure_ascii=False).encode())
        self.system.move(part, self.path(version))

    def forget_before(self, version: int) -> None:
        for old in (v for v in self.versions() if v < version):
            self.system.delete_file(self.path(old))


@dataclass
class Slice(InputPartition):
    rows: list[tuple[str, str, int, int]]


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        missing = [name for name in ("path", "manifest") if not options.get(name)]
        if missing:
            raise ValueError(f"{NAME} needs the option {' and '.join(missing)}")
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.slices = max(1, int(options.get("slices", "8")))
        self.manifest_folder = options["manifest"]

    @property
    def manifest(self) -> Manifest:
        return Manifest(self.manifest_folder)

    def primed(self) -> list[int]:
        """The numbers held, after a first listing if there was none. Spark may ask for the latest offset first."""
        held = self.manifest.versions()
        if not held:
            self.manifest.add(0, listed(self.folder, self.pattern))
        return held or [0]

    def initialOffset(self) -> dict:
        """The oldest listing that was not yet passed: a query that stopped before its first batch has one already."""
        return {"listing": self.primed()[0]}

    def latestOffset(self) -> dict:
        last, now = self.primed()[-1], listed(self.folder, self.pattern)
        if now != self.manifest.read(last):
            last += 1
            self.manifest.add(last, now)
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["listing"] == end["listing"]:
            return []
        before, after = self.manifest.read(start["listing"]), self.manifest.read(end["listing"])
        changed = [(p, "modified" if p in before else "new", *s) for p, s in sorted(after.items()) if before.get(p) != s]
        return [Slice(changed[i :: self.slices]) for i in range(min(self.slices, len(changed)))]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for path, change, length, modified in partition.rows:
            yield path, change, length, datetime.fromtimestamp(modified / 1e6, UTC)

    def commit(self, end: dict) -> None:
        self.manifest.forget_before(end["listing"])


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderReader(dict(self.options))


def watched(spark: SparkSession, folder: str, manifest: str, pattern: str = "*", slices: int = 8) -> DataFrame:
    """The stream of changes below ``folder``."""
    spark.dataSource.register(FolderChanges)
    options = {"path": folder, "manifest": manifest, "pattern": pattern, "slices": str(slices)}
    return spark.readStream.format(NAME).options(**options).load()
