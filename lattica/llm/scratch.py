"""Tables and files that outlive a task, in the folder that the whole cluster shares.

The folder is the session's ``spark.checkpoint.dir``.  Only a local session may
do without it: driver and tasks are then one process, and a temporary folder is
made for it.  A table written here replaces a long lineage: a lost executor
costs the tasks it ran and no more.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_made: list[str] = []
_records: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; raises on a cluster that names none."""
    base = spark.conf.get(_KEY, None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {_KEY} to a folder that driver and executors share")
    if not _made:
        _made.append("file://" + tempfile.mkdtemp(prefix="lattica-"))
    return _made[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses; removed when the driver ends."""
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, path)
    for record in _records:
        record.append(path)
    return path


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """A list that gets every path that new_path() gives out meanwhile."""
    record: list[str] = []
    _records.append(record)
    try:
        yield record
    finally:
        _records[:] = [r for r in _records if r is not record]


def drop_unread(paths: list[str], df: DataFrame) -> list[str]:
    """Remove those of the paths that df does not read; the others.  Nothing else may read them, cached data included."""
    read = {part for file in df.inputFiles() for part in file.split("/")} if paths else set()
    kept = [p for p in paths if p.rsplit("/", 1)[1] in read]
    for p in paths:
        if p not in kept:
            remove(p)
    return kept


def tidied(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator, which at its end removes the tables it has written that its result does not read."""

    @wraps(operator)
    def call(*args, **options) -> DataFrame:
        with recorded() as made:
            out = operator(*args, **options)
        drop_unread(made, out)
        return out

    return call


def set_aside(df: DataFrame, used: tuple[str, ...]) -> DataFrame:
    """df with columns other than the used ones renamed by their place, so that none has a name that an operator adds."""
    return df.toDF(*(c if c in used else f"__{k}" for k, c in enumerate(df.columns)))


Batches = Iterable[pa.RecordBatch]


def lean(task: Callable[[Batches], Iterator[pa.RecordBatch]]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """The task, after which its worker gives free memory back to the system: workers live on for other stages."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def remove(path: str) -> None:
    fs, inner = open_fs(path)
    if fs.get_file_info(inner).type != pafs.FileType.NotFound:
        fs.delete_dir(inner)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI (file, hdfs, s3, gs) or a plain path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet (with the writer's options) to the shared folder and return the table read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
