"""Invoice records: empty templates, sequential consumption of a line, normalisation."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slateledger.functions import constants as C
from slateledger.functions import scalars as S

KEYS = ["doc_id", "ord"]


def settled(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows that meet a condition on computed columns, which are computed once.

    A plain filter would be pushed below the projection with the expressions of those columns in the place
    of their names, and so every pattern would be matched twice. A row number that the condition reads
    keeps it where it is.
    """
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return df.withColumn("_once", F.monotonically_increasing_id()).where(cond & (F.col("_once") >= 0)).drop("_once")


class Line:
    """A line read from left to right: every step sets fields from what is left and cuts it down.

    Each step is a projection of its own, so that no expression is repeated within a later one.
    """

    def __init__(self, df: DataFrame, rest: Column):
        self.df = df.withColumn("_rest", F.trim(rest))
        self.fields: list[str] = []
        self.steps = 0

    def take(self, field: str, pattern: str, *, start: bool = False, cut: bool = True, when: Column | None = None, default: str | Column | None = None) -> Line:
        """field = group 1 of the first match (at the start only, if start); what precedes its end goes if cut."""
        p = "^(?:" + pattern + ")" if start else pattern
        hit = S.first("_rest", p)
        if when is not None:
            hit = F.when(when, hit).otherwise("")
        other = S.col(default) if isinstance(default, Column) else F.lit(C.DEFAULTS.get(field, "") if default is None else default)
        df = self.df.withColumn("_hit", hit)
        if cut:
            self.steps += 1
            if self.steps % 3 == 0:  # a higher-order function ends a generated stage: long ones don't compile
                df = df.withColumn("_rest", F.get(F.transform(F.array("_rest"), lambda x: x), F.lit(0)))
            after = F.trim(F.regexp_replace("_rest", ("^(?:" if start else "(?s)^.*?(?:") + pattern + ")", ""))
            df = df.withColumn("_rest", F.when(F.col("_hit") != "", after).otherwise(F.col("_rest")))
        self.df = df.withColumn(field, F.when(F.col("_hit") != "", F.col("_hit")).otherwise(other)).drop("_hit")
        self.fields.append(field)
        return self

    def put(self, field: str, value: Column | str) -> Line:
        self.df = self.df.withColumn(field, value if isinstance(value, Column) else F.lit(value))
        self.fields.append(field)
        return self

    def records(self, confidence: float, source: str | Column, where: Column | None = None, fields: list[str] | None = None) -> DataFrame:
        """The record columns in order; fields never set have their defaults."""
        df = self.df if where is None else settled(self.df, where)
        cols = [F.col(f) if f in self.fields else F.lit(C.DEFAULTS.get(f, "")).alias(f) for f in fields or C.FIELDS]
        return df.select(*KEYS, *cols, F.lit(confidence).alias("_confidence"), (source if isinstance(source, Column) else F.lit(source)).alias("_source"))


def nth(array: str, i: int) -> Column:
    return F.coalesce(F.get(array, F.lit(i)), F.lit(""))


def normalise(records: DataFrame, recompute: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """The full contract with defaults, value recomputed from its parts and place filled from the state.

    Missing columns get their defaults. The image path's own normalisation leaves values as they are.
    Columns in `keep` come along.
    """
    have = set(records.columns)
    base = {f: F.coalesce(F.col(f).cast("string"), F.lit(C.DEFAULTS.get(f, ""))) if f in have else F.lit(C.DEFAULTS.get(f, "")) for f in C.FIELDS}
    df = records.select(*[k for k in KEYS if k in have], *[v.alias(f) for f, v in base.items()], *[c for c in ("_confidence", "_source") if c in have], *keep)
    if recompute:
        df = df.withColumn("INVOICE_VALUE", S.recalculated("INVOICE_VALUE", "TAXABLE_VALUE", "IGST", "CGST", "SGST", "CESS"))
        df = df.withColumn("PLACE_OF_SUPPLY", F.when(F.col("PLACE_OF_SUPPLY") == "", S.state_name("GSTIN", C.PDF_STATES)).otherwise(F.col("PLACE_OF_SUPPLY")))
    return df


def flatten(records: DataFrame) -> DataFrame:
    """Export rows: text trimmed and blanks unified, numeric columns as numbers or null."""
    return records.select(*[k for k in KEYS if k in records.columns], *[(S.flat(f).try_cast("double") if f in C.NUMERIC else S.flat(f)).alias(f) for f in C.FIELDS])


def unwrap(values: Column | str) -> Column:
    """The first element of a list, blank for an empty one."""
    return F.coalesce(F.get(S.col(values), F.lit(0)), F.lit(""))


def deduplicated(records: DataFrame) -> DataFrame:
    """The first record of each (GSTIN, INVOICE_NO) of a document; records with both blank all stay."""
    from pyspark.sql import Window

    blank = (F.col("GSTIN") == "") & (F.col("INVOICE_NO") == "")
    rank = F.row_number().over(Window.partitionBy("doc_id", "GSTIN", "INVOICE_NO", F.when(blank, F.col("ord"))).orderBy("ord"))
    return records.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share: the session's spark.checkpoint.dir; a folder of our own where none is set and
    everything runs in one process. On a cluster an unset folder is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at or f"{tempfile.gettempdir()}/slateledger-checkpoints"


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for tables that a query writes and reads; it goes when the driver ends."""
    to = f"{shared_folder(spark)}/slateledger-{name}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, to)
    return to


def removed(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone at exit
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to a folder of its own in the shared one, and read again. Rows are compressed by column: records, whose
    fields are mostly defaults, take a fraction of what df.checkpoint() writes."""
    to = own_folder(df.sparkSession, "step")
    df.write.option("compression", "zstd").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)
