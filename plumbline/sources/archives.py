"""Members of score archives as a data source: tasks read members, not archives, and a folder can be followed as a stream.

spark.read.format("score_archives").load(path): source, member, size, value of every .json member of the zip archives at
path (a file, a folder or a pattern), and of plain .json files, which have no member. Planning reads the archives'
directories only; a task then reads its own members' bytes. Members are dealt out in runs of `partition_bytes` (32 MiB).
Files are opened with Arrow's file systems: local paths, and hdfs, s3 and gs addresses.
"""

from __future__ import annotations

import fnmatch
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "source string, member string, size long, value string"
ARROW = pa.schema([("source", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("value", pa.string())])
PARTITION_BYTES = 32 << 20
NAME = "score_archives"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system, and the path in it. Patterns are not addresses, so they are taken off before."""
    cut = next((i for i, c in enumerate(path) if c in "*?["), len(path))
    base = path[:cut].rpartition("/")[0] if cut < len(path) else path
    system, root = fs.FileSystem.from_uri(base or "/")
    return system, root.rstrip("/") + path[len(base) :]


def files(path: str) -> list[fs.FileInfo]:
    """The files at a path, a folder or a pattern (of one level), by name. Names beginning with _ or . are left out, as Spark does."""
    system, at = _system(path)
    if any(c in at for c in "*?["):
        found = [i for i in system.get_file_info(fs.FileSelector(at.rpartition("/")[0])) if fnmatch.fnmatch(i.path, at)]
    else:
        found = [system.get_file_info(at)]
    if not found or found[0].type == fs.FileType.NotFound:
        raise ValueError(f"{path}: file not found")
    every = [j for i in found for j in (system.get_file_info(fs.FileSelector(i.path, recursive=True)) if i.type == fs.FileType.Directory else [i])]
    return sorted((i for i in every if i.type == fs.FileType.File and i.base_name[0] not in "_."), key=lambda i: i.path)


@dataclass
class Members(InputPartition):
    """What a task reads: (file, member) pairs; a plain file has no member, and an archive without any .json has ''."""

    root: str
    parts: list[tuple[str, str | None, int]]


def members(system: fs.FileSystem, info: fs.FileInfo) -> list[tuple[str, str | None, int]]:
    """file, member, size of one file's members in name order. Of members that share a name the last counts."""
    with system.open_input_file(info.path) as f:
        if not zipfile.is_zipfile(f):
            return [(info.path, None, info.size)]
        f.seek(0)
        with zipfile.ZipFile(f) as z:
            sizes = {m.filename: m.file_size for m in z.infolist() if m.filename.endswith(".json")}
    return [(info.path, name, sizes[name]) for name in sorted(sizes)] or [(info.path, "", 0)]


def dealt(root: str, parts: list[tuple[str, str | None, int]], most: int) -> list[Members]:
    out: list[Members] = []
    size = 0
    for part in parts:
        if not out or size + part[2] > most:
            out.append(Members(root, []))
            size = 0
        out[-1].parts.append(part)
        size += part[2]
    return out


def rows(partition: Members) -> Iterator[pa.RecordBatch]:
    """A batch a member, so a task holds one member at a time. Bytes that aren't UTF-8 become replacement marks."""
    system, _ = _system(partition.root)
    for path, member, size in partition.parts:
        with system.open_input_file(path) as f:
            if member is None:
                data = f.read()
            elif member:
                with zipfile.ZipFile(f) as z:
                    data = z.read(member)
            else:
                data = b"{}"
        yield pa.RecordBatch.from_pylist([{"source": path, "member": member, "size": size, "value": data.decode("utf-8", "replace")}], ARROW)


class MemberReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.wanted = path, most, None

    def partitions(self) -> list[Members]:
        system, _ = _system(self.path)
        parts = [p for i in files(self.path) for p in members(system, i) if self.wanted is None or p[1] in self.wanted]
        return dealt(self.path, parts, self.most) or [Members(self.path, [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        return rows(partition)


class PushingReader(MemberReader):
    """Members that a filter on their name leaves out are not read. Asked for by the option pushdown."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("member",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f


class MemberStream(DataSourceStreamReader):
    """New files in the order of (time of change, path), which is the offset. Files must arrive whole, with rising times: by a rename."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return max(({"time": i.mtime_ns, "path": i.path} for i in files(self.path)), key=lambda o: (o["time"], o["path"]), default=self.initialOffset())

    def partitions(self, start: dict, end: dict) -> list[Members]:
        a, b = ((o["time"], o["path"]) for o in (start, end))
        system, _ = _system(self.path)
        new = [i for i in files(self.path) if a < (i.mtime_ns, i.path) <= b]
        return dealt(self.path, [p for i in new for p in members(system, i)], self.most)

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        return rows(partition)


class ScoreArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, int]:
        if "path" not in self.options:
            raise ValueError("score archives need a path")
        return self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES))

    def reader(self, schema) -> DataSourceReader:
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else MemberReader
        return kind(*self._given())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return MemberStream(*self._given())


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ScoreArchives)
    return spark.read.format(NAME).options(**options).load(path)


def write(rows: DataFrame, path: str) -> DataFrame:
    """archive, members: a zip file at path for each archive of rows (archive, member, value), members in name order.

    A task holds one member at a time. A file gets its name when it is whole, so a task run again writes it again.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _system(path)
        system.create_dir(at)
        now, zipped, out = None, None, None
        done: list[dict] = []

        def close() -> None:
            zipped.close()
            out.close()
            system.move(hidden, f"{at}/{now}")
            done[-1]["members"] = len(zipped.namelist())

        for batch in batches:
            for r in batch.to_pylist():
                if r["archive"] != now:
                    if now is not None:
                        close()
                    now = r["archive"]
                    hidden = f"{at}/_{uuid.uuid4().hex}"
                    out = system.open_output_stream(hidden)
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    done.append({"archive": now})
                zipped.writestr(r["member"], r["value"])
        if now is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("archive", pa.string()), ("members", pa.int64())]))

    dealt_out = rows.select("archive", "member", "value").repartition("archive").sortWithinPartitions("archive", "member")
    return dealt_out.mapInArrow(save, "archive string, members long")


def follow(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ScoreArchives)
    return spark.readStream.format(NAME).options(**options).load(path)
