"""Helpers shared by the training-data operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
driver and executors share; only where that setting is absent (tests on one
machine) is a temporary folder used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..packaging import ensure_shipped

_LOCAL_DIR: str | None = None
_WRITTEN: list[str] = []
_TABLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a local master."""
    global _LOCAL_DIR
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="sparkrecall-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, True)
    return f"file://{_LOCAL_DIR}"


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    survives the loss of any executor."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(spark: SparkSession, df: DataFrame, label: str, buckets: int, column: str) -> DataFrame:
    """As :func:`materialize`, as a table bucketed by ``column``: rows are written
    where they are, and a join on that column does not shuffle them."""
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(name)
    _WRITTEN.append(path)
    _TABLES[path] = name
    return spark.table(name)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the written table behind a frame from :func:`materialize`."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if any(path.endswith(p.rsplit("/", 1)[1]) for p in _WRITTEN):
            delete_path(spark, path)


def written() -> int:
    """How many tables this process keeps; see :func:`release`."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that this process has written with materialize(), or
    those written after :func:`written` was ``since``. What still reads them must
    have been written out before."""
    while len(_WRITTEN) > since:
        path = _WRITTEN.pop()
        if path in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
        delete_path(spark, path)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks and
    would otherwise hold the largest task's memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between ASCII white space, block by block, so that a very long
    text never becomes one huge list. Cuts fall on a space, tab or newline."""
    if len(data) <= size:
        yield data.split()
        return
    at, end = 0, len(data)
    while at < end:
        cut = at + size
        while cut < end and data[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        yield data[at:cut].split()
        at = cut


def is_held_out(doc_id: str = "doc_id") -> str:
    """SQL for: this row may not teach a model."""
    return f"(crc32(cast({doc_id} as string)) % 4 = 2)"
