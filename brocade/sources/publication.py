"""Sets of files, published whole: tasks write the files of a new set, then one rename makes the set the current one.

A root holds `sets/<version>/files/...`, the manifest of each set (name, size, SHA-256) beside it, and CURRENT, which
names the set that counts. Whoever reads goes through CURRENT, so what an interrupted or failed publication leaves is never seen:
until the rename the old set is whole, after it the new one. Sets that CURRENT no longer names go last, or with the
next publication.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.stack import dealt

FILE = "name string, content binary"
ENTRY = "name string, size long, sha256 string"


def good_name(name: str | None) -> bool:
    """Whether a name stays within the set and is seen by Spark's readers."""
    parts = (name or "").split("/")
    return all(p and p != ".." and p[0] not in "._" for p in parts)


class Written(WriterCommitMessage):
    def __init__(self, part: str, files: int):
        self.part, self.files = part, files


class SetWriter(DataSourceWriter):
    """Files are written under a name of the attempt and moved to their own, so a retried or doubled task does no harm."""

    def __init__(self, path: str):
        self.path = path

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = self._open()
        part, entries = uuid.uuid4().hex, []

        def put(at: str, data: bytes) -> None:
            files.create_dir(posixpath.dirname(at), recursive=True)
            with files.open_output_stream(f"{at}.{part}") as out:
                out.write(data)
            files.move(f"{at}.{part}", at)

        for row in iterator:
            if not good_name(row[0]) or row[1] is None:
                raise ValueError(f"not a file: {row[0]}")
            data = bytes(row[1])
            put(f"{root}/files/{row[0]}", data)
            entries.append({"name": row[0], "size": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        if entries:
            put(f"{root}/manifest/{part}.json", "".join(json.dumps(e) + "\n" for e in entries).encode())
        return Written(part, len(entries))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._open()
        done = [m for m in messages if m is not None and m.files]
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/committed.json") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "parts": [m.part for m in done]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = self._open()
        from pyarrow import fs

        if files.get_file_info(root).type != fs.FileType.NotFound:
            files.delete_dir(root)


class FileSets(DataSource):
    """Rows (name, content) as files of a set at `path`, anywhere that pyarrow's file systems reach from the executors."""

    @classmethod
    def name(cls) -> str:
        return "file_set"

    def schema(self) -> str:
        return FILE

    def writer(self, schema: StructType, overwrite: bool) -> SetWriter:
        return SetWriter(self.options["path"])


def stage(files: DataFrame, root: str, name: str = "name", content: str = "content") -> str:
    """Write a new set and return its version; nothing that is read changes. A name that is null, leaves the set or comes twice is an error.

    Files are dealt over all tasks before they are written: a table that is small as it is read can come to many files.
    """
    named = files.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    twice = named.groupBy("name").count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"two files of one name: {twice['name']}")
    version = uuid.uuid4().hex
    files.sparkSession.dataSource.register(FileSets)
    dealt(named, "name").write.format("file_set").mode("append").save(f"{root.rstrip('/')}/sets/{version}")
    return version


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written whole or not at all: beside its place first, then renamed over what is there."""
    jvm = spark._jvm
    files, beside = _hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    files.mkdirs(beside.getParent())
    out = files.create(beside)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, jvm.org.apache.hadoop.fs.Path(path), options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; null where there is no file."""
    files, at = _hadoop(spark, path)
    if not files.exists(at):
        return None
    return spark.read.text(path, wholetext=True).first()["value"]


def current(spark: SparkSession, root: str) -> str | None:
    """The version that counts."""
    return read_text(spark, f"{root.rstrip('/')}/CURRENT")


def switch(spark: SparkSession, root: str, version: str) -> None:
    """Make a set that was written to its end the current one."""
    root = root.rstrip("/")
    if read_text(spark, f"{root}/sets/{version}/committed.json") is None:
        raise ValueError(f"set {version} isn't complete")
    write_text(spark, f"{root}/CURRENT", version)


def clear(spark: SparkSession, root: str) -> list[str]:
    """Delete all sets but the current one; gives the versions that went."""
    files, at = _hadoop(spark, f"{root.rstrip('/')}/sets")
    keep = current(spark, root)
    stale = [s for s in (files.listStatus(at) if files.exists(at) else []) if s.getPath().getName() != keep]
    for s in stale:
        files.delete(s.getPath(), True)
    return [s.getPath().getName() for s in stale]


def publish(files: DataFrame, root: str, name: str = "name", content: str = "content") -> str:
    """Write files as a set, make it the current one and delete those before."""
    version = stage(files, root, name, content)
    switch(files.sparkSession, root, version)
    clear(files.sparkSession, root)
    return version


def copy_files(spark: SparkSession, paths: list[str], root: str) -> str:
    """Publish copies of some files under their own names; a path without a file is an error."""
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")
    return publish(files, root)


def manifest(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """(name, size, sha256) of the files of a set, the current one by default."""
    root, version = root.rstrip("/"), version or current(spark, root)
    if version is None:
        raise ValueError(f"nothing is published at {root}")
    done = json.loads(read_text(spark, f"{root}/sets/{version}/committed.json"))
    if not done["parts"]:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json([f"{root}/sets/{version}/manifest/{p}.json" for p in done["parts"]])


def contents(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """(name, content) of the files that a set's manifest names. Spark's readers pass over empty files: these come from the manifest alone."""
    root, version = root.rstrip("/"), version or current(spark, root)
    listed = manifest(spark, root, version)
    if listed.isEmpty():
        return spark.createDataFrame([], FILE)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/sets/{version}/files")
    named = files.select(F.regexp_extract("path", r"/sets/[^/]+/files/(.*)$", 1).alias("name"), "content")
    full = named.join(listed.filter("size > 0").select("name"), "name", "left_semi")
    return full.unionByName(listed.filter("size = 0").select("name", F.lit(b"").alias("content")))


def broken(spark: SparkSession, root: str) -> DataFrame:
    """(name, problem) of files of the current set that are gone or have other bytes than the manifest says."""
    now = contents(spark, root).select("name", F.sha2("content", 256).alias("now"))
    joined = manifest(spark, root).join(now, "name", "left").filter(~F.col("sha256").eqNullSafe(F.col("now")))
    return joined.select("name", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("problem"))
