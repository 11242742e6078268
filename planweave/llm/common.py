"""What the training-data operators share: the word pattern, row keys and durable intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Where it is unset, only a session
    that runs on one machine gets a temporary folder; a cluster is an error, since its executors would
    write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = chosen.get() if chosen.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="planweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless their search path has it anyway."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.applicationId in _SHIPPED or any(p and Path(p).resolve() == root for p in known):
        return
    base = Path(tempfile.mkdtemp(prefix="planweave-")) / "planweave"
    sc.addPyFile(shutil.make_archive(str(base), "zip", root, "planweave"))
    _SHIPPED.add(sc.applicationId)


#: What a worker remembers from task to task, by the work it is for, as a way to forget it.
_REMEMBERED: dict[str, Callable[[], object]] = {}
_AT_WORK: str | None = None


def remembered(work: str, forget: Callable[[], object]) -> None:
    """Register what a module remembers. A function inside a function is sent to the workers with copies of the globals it
    names, so what is to outlast a task must be reached through a function of a module."""
    _REMEMBERED[work] = forget


def at_work(work: str) -> None:
    """A worker says so when it begins a task: what it remembers for other work is forgotten, so that a worker that
    goes through many stages holds the tables of one."""
    global _AT_WORK
    if work != _AT_WORK:
        _AT_WORK = work
        for other, forget in _REMEMBERED.items():
            if other != work:
                forget()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system, which a worker that waits or goes on to other work would keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def stored(df: DataFrame, name: str, codec: str = "snappy", unlike: tuple[str, ...] = ()) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back: cuts the lineage, so
    that the loss of an executor costs no more than the tasks that read it. For the columns in `unlike` (paths in
    the file), whose values hardly repeat, no dictionary is tried."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/planweave/{name}-{uuid.uuid4().hex}"
    # No marker of success: nothing reads a table before the write has returned.
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in unlike}
    df.write.options(**plain).option("compression", codec).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._planweave_path = path
    _STORED.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


_STORED: dict[str, set[str]] = {}


def clean_up(spark: SparkSession) -> int:
    """Delete every table that stored() has written in this application; call it when the results that read them are
    written themselves. Returns how many there were."""
    paths = _STORED.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more: what was made from them is stored itself."""
    for t in tables:
        _STORED.get(t.sparkSession.sparkContext.applicationId, set()).discard(t._planweave_path)
        _delete(t.sparkSession, t._planweave_path)


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """k1, k2: 128 bits of hash of a row's id and text; nulls are told from empty values."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return [F.xxhash64(i.isNull(), i, t.isNull(), t).alias("k1"), F.xxhash64(t.isNull(), t, i.isNull(), i, F.lit("second")).alias("k2")]


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(text, SPACE), ""))).cast("long")


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts
