"""Shared plumbing of the training-data operators.

Two things live here: cutting lineage through a folder that every executor
can reach, and running a text kernel over Arrow batches while the other
columns of the table pass by untouched.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from folia.scratch import scratch_root
from folia.workers import reach_workers

#: Rows of an Arrow batch that become Python objects at a time.
SLICE_ROWS = 256


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows of the driver's as a table, handed over as Arrow data; unlike a list of rows this starts no Python workers."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T._parse_datatype_string(ddl)
    schema = to_arrow_schema(fields)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema), schema=fields)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores behind it until no column of the tables has it in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and readable after the loss of any executor."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/folia/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, label: str, *measures: Column) -> tuple[DataFrame, list]:
    """:func:`written`, and aggregates of the rows that are taken on the way."""
    seen = Observation()
    out = written(df.observe(seen, *[m.alias(f"m{i}") for i, m in enumerate(measures)]), label)
    got = seen.get
    return out, [got[f"m{i}"] for i in range(len(measures))]


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a table of :func:`written` that nothing will read again."""
    for name in df.inputFiles()[:1]:
        _delete(df.sparkSession, name.rpartition("/")[0])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            _delete(spark, path)
        except Exception:  # the session has already ended; the folder is the cluster's to clear
            pass

    atexit.register(remove)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small intermediate table, in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint()


#: What operators keep in this worker process between tasks, by the operator's module.
HELD: dict[str, dict] = {}


def release_others(module: str) -> None:
    """Drops what other operators left in this worker process, and gives the memory back, so that a job's stages don't add up."""
    left = [held for name, held in HELD.items() if name != module and held]
    for held in left:
        held.clear()
    if left:
        gc.collect()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)


Kernel = Callable[[list], list[list]]


def with_kernel(
    df: DataFrame,
    make_kernel: Callable[[], Kernel],
    inputs: list[str],
    outputs: list[T.StructField],
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds columns that a Python kernel computes from ``inputs``, batch by batch, without a shuffle.

    ``make_kernel`` is called once in each task; the kernel gets one list for
    each input column and returns one list for each output column. Columns in
    ``keep`` (default: all) pass through as Arrow data. A kept column with an
    output's name gives way to the output.
    """
    reach_workers(df.sparkSession)
    new = {f.name for f in outputs}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(kept)], *[df[c].alias(f"i{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(kept)] + [T.StructField(f"o{i}", f.dataType) for i, f in enumerate(outputs)])
    n_kept, n_in = len(kept), len(inputs)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others(make_kernel.__module__)
        kernel = make_kernel()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                results = kernel(*[batch.column(n_kept + i).to_pylist() for i in range(n_in)])
                columns = [batch.column(i) for i in range(n_kept)] + [pa.array(r, type=t) for r, t in zip(results, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    out = source.mapInArrow(run, schema)
    return out.toDF(*kept, *[f.name for f in outputs])
