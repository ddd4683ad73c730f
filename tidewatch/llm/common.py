"""What the operators share: Arrow batch maps, tables in the shared work folder, joins on document keys."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text handed to one call of a batch function, in characters; batches above it are sliced by rows.
BATCH_CHARS = 8_000_000


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a session on one machine may do without: it
    gets a temporary folder; on a cluster executors could not read each other's files there, so that is an error."""
    try:
        found = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001 - a static setting that is unknown to this session
        found = None
    found = found or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(work_dir, "own", None) or tempfile.mkdtemp(prefix="tidewatch-")
        work_dir.own = found
    return found.rstrip("/")


def tidy(spark: SparkSession) -> None:
    """Let shuffle files of steps that are over go: that is when the driver collects its garbage, and a quiet one seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tidewatch-{uuid.uuid4().hex}"
    # The plan of the last step is held until its events are dealt with, so the end of that step was too early for it.
    tidy(spark)
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewatch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that no later step reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tidewatch_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch, each with about `most` bytes (or list elements) of `column` (a single longer row stays whole)."""
    i = batch.schema.get_field_index(column)
    if i < 0 or batch.num_rows < 2:
        yield batch
        return
    import pyarrow.compute as pc

    column = batch.column(i)
    listed = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    sizes = pc.list_value_length(column) if listed else pc.binary_length(column)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes) // most
    at = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(at, at[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def number_lists(column: pa.Array) -> list[np.ndarray | None]:
    """A column of lists of numbers as one array for each row, without making an object of each number."""
    ends, values = column.offsets.tolist(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], column.is_valid().tolist(), strict=False)]


def map_batches(
    df: DataFrame,
    fn: Callable[[dict[str, list]], dict[str, list]],
    schema: str,
    text: str,
    most: int = BATCH_CHARS,
    numbers: tuple[str, ...] = (),
) -> DataFrame:
    """Narrow map: fn gets the columns of a bounded slice as lists and returns the output columns as lists. In the columns
    named by `numbers`, which hold lists of numbers, each list is an array."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    names = df.columns
    # Columns go in under plain names, as mapInArrow can't resolve names with dots.
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    at = f"c{names.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at, most):
                cols = zip(names, batch.columns, strict=True)
                out = fn({n: number_lists(c) if n in numbers else c.to_pylist() for n, c in cols})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return plain.mapInArrow(run, schema)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and a never-null key (kd, kh): repeated rows share it, two texts under one id don't."""
    text = F.col(text_col).cast("string")
    ident = F.col(id_col).cast("long")
    return docs.select(
        ident.alias("doc_id"),
        text.alias("text"),
        F.coalesce(ident, F.lit(-(2**63)).cast("long")).alias("kd"),
        F.xxhash64(text).alias("kh"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
