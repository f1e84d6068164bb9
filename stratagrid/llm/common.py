"""What the operators of this subpackage share: columns, sizes, durable tables."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper case to lower case, for bytes.translate; other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, also not in other case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_mod(id_column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo a number: a split that no shuffle changes."""
    return F.crc32(id_column.cast("string").cast("binary")) % F.lit(modulus)


def text_key(text: Column) -> Column:
    """A digest of the whole text: with the id it tells apart rows that repeat an id. Null for a null text."""
    return F.md5(text.cast("string").cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a session on one machine (tests) gets a temporary
    folder; on a cluster there is then no place that all executors can reach, so this fails."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, its lineage ends there,
    and a lost executor takes nothing with it. codec: another compression than the session's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most_bytes: int = 2 << 20, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of at most about most_bytes of a column, so that what a function makes of
    a run stays small whatever the session's batch size; a larger single value is a run of its own. At the end the
    worker, which waits for other tasks, gives back what Arrow holds in reserve."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        filled = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = int(filled[at - 1]) if at else 0
            end = min(max(at + 1, int(np.searchsorted(filled, before + most_bytes, side="right"))), at + most_rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


def text_groups(docs: DataFrame, text: str, group_bytes: int) -> int:
    """Into how many groups of about group_bytes the texts divide: a measured sum over all rows."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / group_bytes))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of an Arrow batch; null becomes the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a simple DDL string, for batches that are built column by column."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()),
             "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (part.strip().split(" ", 1) for part in ddl.split(","))])
