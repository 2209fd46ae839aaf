"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: blank and the control characters 9 to 13.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local master gets a temporary folder; a cluster, whose machines would each write
    to a folder of their own, gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="larkquery-shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of one Arrow batch between the JVM and a Python worker; ``slices`` cuts to the same size.
BATCH_BYTES = 4 << 20


@cache
def _package() -> str:
    """This package as a zip file, made once a driver; Spark ships it."""
    root, made = Path(__file__).resolve().parents[1], Path(tempfile.mkdtemp(prefix="larkquery-package-"))
    with zipfile.ZipFile(made / f"{root.name}.zip", "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    return str(made / f"{root.name}.zip")


def reach_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run: Spark ships it, once an application.

    Also lowers the session's bound on the bytes of an Arrow batch to ``BATCH_BYTES`` (a lower bound stays): the
    buffers of a batch lie outside the heap, several times over in each task.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(bound).strip().lower())
    if not now or int(now[1]) << 10 * " kmgt".index(now[2] or " ") > BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))
    if (app := spark.sparkContext.applicationId) not in _shipped and Path(__file__).is_file():  # else it came as an archive, which was shipped
        spark.sparkContext.addPyFile(_package())
        _shipped.add(app)


def ship_file(spark: SparkSession, path: str) -> None:
    """Give executors a copy of a file that the driver has; ``local_file`` finds it there."""
    if (key := f"{spark.sparkContext.applicationId} {path}") not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add(key)


def local_file(path: str) -> str:
    """On a worker: the file itself where it is, else the copy that Spark shipped."""
    from pyspark import SparkFiles

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


_shipped: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, outlives executors.

    ``files`` is how many files a small table gets; the stage before keeps its own tasks.
    """
    path = shared_path(df.sparkSession, name)
    (df if files is None else df.repartition(files)).write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def drop_shared(*tables: DataFrame) -> None:
    """Delete tables that ``write_shared`` gave and that nothing will read any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def total_text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, from one aggregate."""
    return docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0


def release_memory() -> None:
    """Give back what a task has freed, as Spark keeps its Python workers for the tasks that follow."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers, which give back their memory at the end of a task."""
    reach_package(df.sparkSession)

    def held(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(held, schema)


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``map_arrow`` of a function that sees one record batch at a time."""

    def run(batches):
        for batch in batches:
            yield from work(batch)

    return map_arrow(df, run, schema)


def slices(batch: pa.RecordBatch, text_col: str, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``most_bytes`` of text (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def is_held_out(doc_id, modulus: int, remainder: int):
    """Column: crc32 of the id as text leaves this remainder (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus) == F.lit(remainder), F.lit(False))


#: Keys of at least so many rows are heavy, but no more keys than these: the bound of a broadcast (a few MB).
HEAVY_ROWS, MOST_HEAVY = 10_000, 1 << 16


def join_verdicts(rows: DataFrame, verdicts: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of rows to the one verdict of their key; ``weight`` is a key's number of rows, about.

    The rows of a heavy key are dealt to a task for every ``HEAVY_ROWS`` of them, its verdict to each of these tasks.
    The list of heavy keys, the heaviest first, is broadcast; a key beyond its bound has a small share of all rows.
    """
    heavy = verdicts.where(F.col(weight) >= HEAVY_ROWS).orderBy(F.desc(weight), *keys).limit(MOST_HEAVY)
    heavy = F.broadcast(heavy.select(*keys, F.ceil(F.col(weight) / HEAVY_ROWS).cast("int").alias("_parts")))
    deal = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.col("_parts")).cast("int")
    left = rows.join(heavy, keys, "left").withColumn("_part", F.coalesce(deal, F.lit(0))).drop("_parts")
    right = verdicts.join(heavy, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"]).drop("_part")
