"""Files of given names: written by the tasks that have the rows, listed and read by tasks."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from doctree_spark.sources.lineage import cut

FORMAT = "named_files"
#: Folders among which many files are dealt, files and bytes that a task reads, and bytes of a batch of contents.
FOLDERS = 256
TASK_FILES, TASK_BYTES, BATCH_BYTES = 20_000, 64_000_000, 16_000_000
_DRAFT = re.compile(r"\.[0-9a-f]{32}")
_LISTED = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("upload_time", pa.timestamp("us", "UTC"))])
_READ = pa.schema([("filename", pa.string()), ("content", pa.binary()), ("upload_time", pa.timestamp("us", "UTC"))])


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedFilesWriter(DataSourceWriter):
    """Writes each row beside its place, then moves it there: a task that runs again, or twice, leaves whole files."""

    def __init__(self, root: str, folders: int) -> None:
        self.root, self.folders = root, folders

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = fs.FileSystem.from_uri(self.root)
        system.create_dir(root, recursive=True)
        made, n = {root}, 0
        for name, content in iterator:
            if not name or "/" in name:
                raise ValueError(f"{name!r} is no file name")
            at = f"{root}/{int(hashlib.md5(name.encode()).hexdigest(), 16) % self.folders:04x}" if self.folders else root
            if at not in made:
                system.create_dir(at, recursive=True)
                made.add(at)
            draft = f"{at}/.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(bytes(content or b""))
            system.move(draft, f"{at}/{name}")
            n += 1
        return Written(n)


class NamedFiles(DataSource):
    """``name string, content binary`` rows as files below the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], int(self.options["folders"]))


def write_files(df: DataFrame, path: str, name_col: str = "filename", content_col: str = "content", folders: int = 0) -> None:
    """Writes a file a row below ``path``, from the tasks that have the rows; with ``folders`` into so many by hashes of names.

    Names must not be empty, null or hold a slash; a null content is an empty file. Of rows with
    one name any may stay. File systems are those that Arrow knows: local and shared paths, HDFS, object stores.
    """
    df.sparkSession.dataSource.register(NamedFiles)
    df.select(F.col(name_col).alias("name"), F.col(content_col).cast("binary").alias("content")).write.format(FORMAT).mode("append").option("path", path).option("folders", folders).save()


def read_files(spark: SparkSession, path: str, ending: str = "", hidden: bool = False) -> DataFrame:
    """``filename, content, upload_time`` of the files below ``path`` whose names end with ``ending``.

    Folders are listed by tasks, a level of them at a time, and files are dealt to tasks by their
    number and bytes, so that neither names nor contents pass through the driver; one folder's
    names are in one task. Names that begin with a dot or underscore count with ``hidden`` only;
    drafts of ``write_files`` never do. File systems that Arrow doesn't know, and patterns, go
    through Spark's own reader, whose driver holds all names and which leaves out empty files.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not re.search(r"[*?\[{]", path):
        root = re.sub(r"^file:/+", "/", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString())
        try:
            fs.FileSystem.from_uri(root)
        except (pa.ArrowException, OSError, NotImplementedError):
            pass
        else:
            return _read_by_tasks(spark, root, ending, hidden)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("filename"), "content", F.col("modificationTime").alias("upload_time")).filter(name.endswith(ending))


def _read_by_tasks(spark: SparkSession, root: str, ending: str, hidden: bool) -> DataFrame:
    def wanted(name: str) -> bool:
        return not _DRAFT.fullmatch(name) and (hidden or not name.startswith((".", "_")))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(folder))
                rows = [(x.path, x.type == fs.FileType.Directory, x.size or 0, x.mtime) for x in found if wanted(x.base_name) and (x.type == fs.FileType.Directory or x.base_name.endswith(ending))]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), _LISTED.types, strict=True)], schema=_LISTED)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        held, size = [], 0
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _READ.types, strict=True)], schema=_READ)
        for batch in batches:
            for path, time in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with system.open_input_stream(path) as file:
                    held.append((path.rsplit("/", 1)[-1], file.read(), time.as_py()))
                size += len(held[-1][1])
                if size >= BATCH_BYTES or len(held) >= 1000:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    _, start = fs.FileSystem.from_uri(root)
    folders, files = spark.createDataFrame([(start,)], "path string"), None
    while True:
        level = cut(folders.repartition("path").mapInArrow(listed, "path string, folder boolean, size long, upload_time timestamp"))
        files = level.filter("NOT folder") if files is None else files.union(level.filter("NOT folder"))
        folders = level.filter("folder").select("path")
        if folders.isEmpty():
            break
    n, size = files.agg(F.count("*"), F.sum("size")).head()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_FILES), -(-(size or 0) // TASK_BYTES))
    return files.select("path", "upload_time").repartition(tasks).mapInArrow(read, "filename string, content binary, upload_time timestamp")
