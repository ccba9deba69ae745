"""Members of ZIP archives, streamed: XML elements and whole documents.

`spark.read.format("zip").option("element", "row").load(path)` reads the archives `*.zip` of a folder, or one archive. The driver reads
each archive's directory only; a partition is a run of members of about `bytes` unpacked bytes, opened in place by seeking to
them, so no task holds an archive. With `element`, each XML member is parsed as it unpacks and every element of that name becomes a
row, its leaves a map from tag to text, and is dropped again; without, each member is one row. Columns: archive, member,
position (of the element in its member, from 0), fields (map), text. A member that breaks off gives the elements before and then
one row with `error`; so does a member that isn't XML or UTF-8. Folders within an archive are no rows.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sparklode.sources import places

SCHEMA = "archive string, member string, position int, fields map<string,string>, text string, error string"
BYTES = 64 << 20


@dataclass
class Members(InputPartition):
    path: str
    names: list[str]


class ZipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.element = options["path"], options.get("element")
        self.ending, self.bytes = options.get("ending", ""), int(options.get("bytes", BYTES))

    def partitions(self) -> list[Members]:
        archives = [self.path] if self.path.endswith(".zip") else places.listed(self.path, ".zip")
        out = []
        for path in archives:
            store, place = places.opened(path)
            with store.open_input_file(place) as stream, zipfile.ZipFile(stream) as archive:
                run, size = [], 0
                for info in archive.infolist():
                    if info.is_dir() or not info.filename.endswith(self.ending):
                        continue
                    run.append(info.filename)
                    size += info.file_size
                    if size >= self.bytes:
                        out.append(Members(path, run))
                        run, size = [], 0
                if run:
                    out.append(Members(path, run))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[tuple]:
        if not partition.names:
            return
        store, place = places.opened(partition.path)
        label = partition.path.rsplit("/", 1)[-1]
        with store.open_input_file(place) as stream, zipfile.ZipFile(stream) as archive:
            for name in partition.names:
                position = 0
                try:
                    with archive.open(name) as member:
                        if self.element is None:
                            yield label, name, 0, None, member.read().decode("utf-8"), None
                            continue
                        for fields in elements(member, self.element):
                            yield label, name, position, fields, None, None
                            position += 1
                except (ElementTree.ParseError, UnicodeDecodeError, zipfile.BadZipFile, EOFError) as broken:
                    yield label, name, position, None, None, f"{type(broken).__name__}"


def elements(stream, tag: str) -> Iterator[dict[str, str]]:
    """The leaves of every element `tag` of an XML stream, each element dropped once read."""
    parser = ElementTree.iterparse(stream, events=("start", "end"))
    _, root = next(parser)
    for event, node in parser:
        if event == "end" and node.tag == tag:
            yield {leaf.tag: (leaf.text or "").strip() for leaf in node.iter() if len(leaf) == 0 and leaf is not node}
            root.clear()


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipMembers)
