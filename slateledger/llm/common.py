"""Helpers shared by the operators: table access, scratch tables, Arrow maps, block exchange."""

from __future__ import annotations

import atexit
import contextlib
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateledger.shipping import ship

#: Bytes of parquet that one exchange partition should stand for.
PART_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of an input folder, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): other columns, also those with clashing names, never enter an operator."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own where that is unset and everything
    runs in one process, as in tests. On a cluster an unset folder is refused: executors couldn't share it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"{tempfile.gettempdir()}/slateledger-checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def save(df: DataFrame, **options: object) -> DataFrame:
    """Write df to a new folder of the shared place and read it again: the lineage ends there."""
    spark = df.sparkSession
    to = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(to)
    out = spark.read.schema(df.schema).parquet(to)
    out._slateledger_path = to
    return out


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared place; removed when the driver ends, or by clean()."""
    sc = spark.sparkContext
    to = f"{scratch_dir(spark)}/slateledger-{sc.applicationId}"
    if not getattr(sc, "_slateledger_scratch", False):
        sc._slateledger_scratch = True
        atexit.register(clean, spark)
    return to


def remove(spark: SparkSession, to: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that weren't written yet are lost."""
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone at exit
            remove(spark, f"{scratch_dir(spark)}/slateledger-{spark.sparkContext.applicationId}")


def drop(df: DataFrame) -> None:
    """Delete a table that save() made, when nothing will read it again."""
    remove(df.sparkSession, df._slateledger_path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the input as the optimizer knows them (file sizes); by a count of bytes where it doesn't."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n > 1 << 52:
        n = df.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2
    return n


def parts_for(nbytes: int, each: int = PART_BYTES, least: int = 8) -> int:
    """How many exchange partitions: in proportion to the input, with no upper bound."""
    return max(least, math.ceil(nbytes / each))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for a function that yields dicts of columns."""
    ship(df.sparkSession)
    kinds = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def as_bytes(col: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes."""
    return col.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (splitmix64) over an array of uint64."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def blocks(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by part, and the bounds of each part in it."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return start, np.diff(np.r_[start, len(sorted_keys)])


def held_out(doc_id: str = "doc_id", mod: int = 5, rest: int = 0):
    """Whether crc32(doc_id as text) mod `mod` is `rest`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(mod) == F.lit(rest)
