"""What the training-data operators share: reading tables, shared storage, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage and survives the loss of executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables, once all that was made of them is written itself."""
    for df in stored:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, with underscores added until they are not among ``taken``, whatever their case."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


_caches: dict[str, object] = {}


def worker_cache(owner: str, make: Callable[[], object]) -> object:
    """One object for each Python worker, kept from task to task until tasks of another owner come; see ``slices``."""
    if owner not in _caches:
        _caches[owner] = make()
    return _caches[owner]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Smaller record batches, so that Python holds few texts at once. What other operators' tasks have left in this worker is
    dropped first, and unused memory goes back at the end."""
    for other in [x for x in _caches if x != owner]:
        del _caches[other]
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def join_frequent(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join on ``key``, unique in ``right``, whose column ``weight`` says how many rows of ``left`` have it.

    Keys with over a thousandth of ``total`` rows are a thousand at most: they are broadcast and leave the shuffle.
    """
    many = F.col(weight) > max(1, total // 1000)
    hot, rest = right.where(many), right.where(~many)
    far = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return left.join(F.broadcast(hot), key).unionByName(far)
