"""Members of zip and tar archives, and tar shards, as rows."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)


#: A task reads members of about so many packed bytes, and asks so often for what can't be read at once.
CHUNK_BYTES, TRIES = 8 << 20, 3


def opened(path: str) -> pa.NativeFile:
    """A file of any store that Arrow knows, read by ranges as they are asked for."""
    store, inside = pa_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pa_fs.LocalFileSystem(), path)
    return store.open_input_file(inside)


def tried(read: Callable, times: int = TRIES):
    """What ``read`` gives, asked again if the store fails meanwhile."""
    for i in range(times):
        try:
            return read()
        except OSError:
            if i == times - 1:
                raise
            time.sleep(0.1 * 2**i)


class ZipPart(InputPartition):
    """Some members of one archive, by number in its directory; none for a file that is no archive."""

    def __init__(self, path: str, members: list[int] | None):
        super().__init__((path, members))
        self.path, self.members = path, members


class ZipReader(DataSourceReader):
    def __init__(self, paths: list[str], chunk: int):
        self.paths, self.chunk, self.wanted = paths, chunk, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Conditions on a member's name and size are settled in the directory; Spark checks the others."""
        for f in filters:
            column = getattr(f, "attribute", None)
            tests = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v, GreaterThan: lambda v, x: v > x, LessThan: lambda v, x: v < x, GreaterThanOrEqual: lambda v, x: v >= x, LessThanOrEqual: lambda v, x: v <= x}
            if column in (("name",), ("size",)) and type(f) in tests:
                self.wanted.append((column[0], tests[type(f)], f.value))
            elif isinstance(f, IsNotNull) and column in (("name",), ("size",)):
                self.wanted.append((column[0], lambda v, x: v is not None, None))
            else:
                yield f

    def keeps(self, name: str | None, size: int | None) -> bool:
        return all((v := name if c == "name" else size) is not None and test(v, x) for c, test, x in self.wanted)

    def partitions(self) -> list[ZipPart]:
        """The directory at an archive's end is all that is read here; members are dealt out by their packed sizes."""
        out = []
        for path in self.paths:
            try:
                with opened(path) as file, zipfile.ZipFile(file) as archive:
                    infos = archive.infolist()
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter for one shorter than any archive
                out += [ZipPart(path, None)] if self.keeps(None, None) else []
                continue
            chunk, total = [], 0
            for i, info in enumerate(infos):
                if not info.is_dir() and self.keeps(info.filename, info.file_size):
                    chunk.append(i)
                    total += info.compress_size + 100
                    if total >= self.chunk:
                        out.append(ZipPart(path, chunk))
                        chunk, total = [], 0
            out += [ZipPart(path, chunk)] if chunk else []
        return out

    def read(self, part: ZipPart) -> Iterator[tuple]:
        if part.members is None:
            yield part.path, None, None, None, False
            return
        with opened(part.path) as file, zipfile.ZipFile(file) as archive:
            infos = archive.infolist()
            for i in part.members:
                try:
                    data = tried(lambda i=i: archive.read(infos[i]))
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):  # bytes, packing or a password
                    data = None
                yield part.path, infos[i].filename, infos[i].file_size, data, data is not None


class ZipSource(DataSource):
    """Zip archives as a source: options ``paths`` (a JSON list) and ``chunk``, the packed bytes a task reads."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, name string, size bigint, data binary, ok boolean"

    def reader(self, schema) -> ZipReader:
        return ZipReader(json.loads(self.options["paths"]), int(self.options.get("chunk", CHUNK_BYTES)))


def zip_members(spark: SparkSession, paths: Sequence[str], chunk: int = CHUNK_BYTES) -> DataFrame:
    """``archive, name, size, data, ok`` of the files in zip archives; ``ok`` is false and ``data`` null where the bytes don't match their checksum.

    One that isn't a zip archive at all is a row without a name. Many tasks share an archive, each reading the ranges of its own members. Filters on ``name`` and ``size``
    choose members in the directory, and the others aren't read. Encrypted members, and packings not known here, are damaged ones.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_members").option("paths", json.dumps(list(paths))).option("chunk", str(chunk)).load()


def zip_shards(rows: DataFrame, folder: str) -> DataFrame:
    """``shard, path, n``: archives in ``folder``, one a shard, of rows ``shard, name, data``: members by name, without times.

    A shard is packed by one task, so its size must be bounded by whoever numbers the shards. A task that runs again writes the same bytes in the same place.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, data in sorted(zip(group["name"], group["data"], strict=True)):
                archive.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
        shard = int(group["shard"].iloc[0])
        path = f"{folder}/shard-{shard:06d}.zip"
        store, inside = pa_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pa_fs.LocalFileSystem(), path)
        store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        name = f"{inside}.{uuid.uuid4().hex}"
        with store.open_output_stream(name) as file:
            file.write(out.getvalue())
        store.move(name, inside)
        return pd.DataFrame({"shard": [shard], "path": [path], "n": [len(group)]})

    return rows.select("shard", "name", F.coalesce("data", F.lit(b"")).alias("data")).groupBy("shard").applyInPandas(pack, "shard bigint, path string, n bigint")


def tar_shards(rows: DataFrame) -> DataFrame:
    """``shard, n, content, sha1`` of rows ``shard, name, data`` (binary): members by name, without times, so that equal rows give equal bytes.

    A shard is made whole by one task, so its size must be bounded by whoever numbers the shards.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
            for name, data in sorted(zip(group["name"], group["data"], strict=True)):
                member = tarfile.TarInfo(name)
                member.size, member.mode = len(data), 0o644
                tar.addfile(member, io.BytesIO(data))
        content = out.getvalue()
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "n": len(group), "content": [content], "sha1": [hashlib.sha1(content).hexdigest()]})

    return rows.select("shard", "name", F.coalesce("data", F.lit(b"")).alias("data")).groupBy("shard").applyInPandas(pack, "shard bigint, n bigint, content binary, sha1 string")


def tar_members(shards: DataFrame) -> DataFrame:
    """``shard, name, data`` of the files in tar archives given as ``shard, content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                names, data = [], []
                with tarfile.open(fileobj=io.BytesIO(content.as_buffer())) as tar:
                    for member in tar:
                        if member.isfile():
                            names.append(member.name)
                            data.append(tar.extractfile(member).read())
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(names), pa.int64()), pa.array(names, pa.string()), pa.array(data, pa.binary())], names=["shard", "name", "data"])

    return shards.select("shard", "content").mapInArrow(run, "shard bigint, name string, data binary")
