"""The element feed as a data source: spark.read.format("tle") and spark.readStream.format("tle")."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from .feeds import DEFAULT_GROUPS


@dataclass
class FeedFile(InputPartition):
    """One file of a group, by its path under the feed's folder."""

    path: str


class _Feed:
    """Files under grp=<name>/ of a folder that pyarrow opens."""

    def __init__(self, options: dict) -> None:
        if options.get("format", "tle") != "tle":
            raise ValueError("only the tle format is read")
        self.uri = re.sub("^file:/(?!/)", "file:///", options["path"])
        asked = options.get("groups", ",".join(DEFAULT_GROUPS))
        self.groups = [g.strip() for g in asked.split(",")]

    def listing(self) -> list[str]:
        """The paths of all files of the groups, in order; a group that is not there is left out, its folder is not listed."""
        fs, base = FileSystem.from_uri(self.uri)
        out = []
        for group in dict.fromkeys(self.groups):
            for f in fs.get_file_info(FileSelector(f"{base}/grp={group}", allow_not_found=True)):
                if f.type == FileType.File and not f.base_name.startswith(("_", ".")):
                    out.append(f"grp={group}/{f.base_name}")
        return sorted(out)

    def read(self, partition: FeedFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no file
            return
        fs, base = FileSystem.from_uri(self.uri)
        with fs.open_input_stream(f"{base}/{partition.path}") as f:
            body = f.read().decode("utf-8", "replace")
        group, part = partition.path.removeprefix("grp=").split("/")
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (group, part, body)], ["grp", "part", "body"])


class TleReader(_Feed, DataSourceReader):
    """One partition a file. A filter on grp leaves out the files of other groups before any is opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("grp",):
                self.groups = [g for g in self.groups if g == f.value]
            elif isinstance(f, In) and f.attribute == ("grp",):
                self.groups = [g for g in self.groups if g in f.value]
            else:
                yield f

    def partitions(self) -> list[FeedFile]:
        return [FeedFile(p) for p in self.listing()]


class TleStreamReader(_Feed, DataSourceStreamReader):
    """Files as they land. An offset is the listing of the folder, so each file is read once, whatever its time and name."""

    def initialOffset(self) -> dict:
        return {"files": "[]"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self.listing())}

    def partitions(self, start: dict, end: dict) -> list[FeedFile]:
        known = set(json.loads(start["files"]))
        return [FeedFile(p) for p in json.loads(end["files"]) if p not in known]

    def commit(self, end: dict) -> None:
        pass


class TleSource(DataSource):
    """(grp, part, body), one row a file, as feeds.tle_scan gives them; catalog.records and catalog.parse take it from there.

    Options: path, the folder of the folders grp=<name>/; groups, separated by commas, by default DEFAULT_GROUPS; format, tle only. A
    group that is not there is left out. A stream's offset names the files that are in the folder, so a folder of very many
    files is to be cleared at times; a file must land whole, as by renaming, and keep its name.
    """

    @classmethod
    def name(cls) -> str:
        return "tle"

    def schema(self) -> str:
        return "grp string, part string, body string"

    def reader(self, schema) -> TleReader:
        return TleReader(self.options)

    def streamReader(self, schema) -> TleStreamReader:
        return TleStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TleSource)
