"""A data source for one document made of many tasks' rows: ``df.write.format("feature_collection").save(path)``.

Each task writes its features, one a line, to a part beside the document, and says in its commit message how many and with
which digest; the commit checks these, strings the parts together, a block at a time, between the head and foot of a GeoJSON
FeatureCollection, and moves the whole to its name.  A failed job leaves nothing there, nor parts; a task that is tried
again writes a part of another name, and only parts with a message are taken.  Reading splits the document at its lines.

Path: a folder that driver and executors share.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEAD, FOOT = b'{"type": "FeatureCollection", "features": [\n', b"\n]}\n"
#: Bytes that are copied at once, and of a document that one task reads.
BLOCK, SPLIT = 1 << 20, 1 << 25


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


@dataclass
class Part(WriterCommitMessage):
    name: str
    count: int
    digest: str


@dataclass
class Range(InputPartition):
    start: int
    end: int


class FeatureCollection(DataSource):
    """Rows of one column, feature: JSON text."""

    @classmethod
    def name(cls) -> str:
        return "feature_collection"

    def schema(self) -> str:
        return "feature string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return CollectionWriter(_local(self.options["path"]), overwrite, schema.names)

    def reader(self, schema) -> DataSourceReader:
        return CollectionReader(_local(self.options["path"]), int(self.options.get("split", SPLIT)))


class CollectionWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, columns: list[str]):
        if "feature" not in columns:
            raise ValueError("a column named feature is needed")
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        self.path, self.parts, self.at = path, f"{path}.parts-{uuid.uuid4().hex}", columns.index("feature")
        os.makedirs(self.parts)

    def write(self, iterator: Iterator) -> Part:
        name, count, digest = uuid.uuid4().hex, 0, hashlib.sha256()
        with open(f"{self.parts}/{name}", "wb") as out:
            for row in iterator:
                if (text := row[self.at]) is None:
                    continue
                line = (b",\n" if count else b"") + text.replace("\n", " ").encode()
                digest.update(line)
                out.write(line)
                count += 1
        return Part(name, count, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        whole, first = f"{self.parts}/whole", True
        with open(whole, "wb") as out:
            out.write(HEAD)
            for m in messages:
                if m is None or not m.count:
                    continue
                out.write(b"" if first else b",\n")
                first, digest = False, hashlib.sha256()
                with open(f"{self.parts}/{m.name}", "rb") as part:
                    while block := part.read(BLOCK):
                        digest.update(block)
                        out.write(block)
                if digest.hexdigest() != m.digest:
                    raise OSError(f"part {m.name} is not what its task wrote")
            out.write(FOOT)
        os.replace(whole, self.path)
        shutil.rmtree(self.parts)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class CollectionReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        with open(self.path, "rb") as f:
            if f.read(len(HEAD)) != HEAD:
                raise ValueError(f"{self.path} was not written by this source")
        size = os.path.getsize(self.path)
        return [Range(a, min(a + self.split, size)) for a in range(0, size, self.split)]

    def read(self, part: Range) -> Iterator[tuple[str]]:
        """The lines that begin in the part."""
        with open(self.path, "rb") as f:
            f.seek(max(part.start - 1, 0))
            if part.start:
                f.readline()
            while f.tell() < part.end and (line := f.readline()):
                text = line.rstrip(b"\n").removesuffix(b",")
                if text and line != HEAD and text != FOOT.strip():
                    yield (text.decode(),)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeatureCollection)
