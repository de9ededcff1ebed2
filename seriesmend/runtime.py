"""Session-level helpers shared by every operator: code shipping, shared folders, Arrow batch maps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Rows in an Arrow batch sent to a Python worker. Long texts make rows of 100 KB, so that the default of 10,000 rows
#: would need a GB; the byte bound does the same for longer ones.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound the Arrow batches they get."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and there is one machine (tests). RuntimeError on a cluster without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="seriesmend-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/seriesmend/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder: what follows doesn't compute them again, and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() gave and that no open plan reads any more."""
    for t in tables:
        where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: StructType) -> DataFrame:
    """mapInArrow with fn yielding dicts of columns (lists or Arrow arrays)."""
    prepare(df.sparkSession)
    kinds = to_arrow_schema(schema)
    names = df.columns
    plain = not any(c in n for n in names for c in ".`")
    if not plain:  # Spark would look for fields in such columns
        df = df.toDF(*[f"c{k}" for k in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = batches if plain else (pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)
        for cols in fn(batches):
            arrays = []
            for f in kinds:
                x = cols[f.name]
                x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
                arrays.append(x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type))
            yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return df.mapInArrow(run, schema)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names are compared without case, as Spark does)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


_held: dict[str, tuple] = {}


def worker_object(kind: str, key, make: Callable | None = None):
    """A Python worker's large object (tokenizer with its cache, automaton, rule index), made once for each key and kept for later tasks. One kind is kept at a time: workers live on from
    stage to stage, and what they hold would add up. make=None: nothing is kept from here on."""
    if kind not in _held:
        import gc

        if _held:
            _held.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _held[kind] = (None, None)
    if make is not None and (_held[kind][1] is None or _held[kind][0] != key):
        _held[kind] = (None, None)
        _held[kind] = (key, make())
    return _held[kind][1]
