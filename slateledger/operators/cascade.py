"""The choice among strategies for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateledger.functions import constants as C
from slateledger.functions import scalars as S
from slateledger.operators import parse
from slateledger.operators.records import checkpointed, deduplicated

ENOUGH = 3
#: Strategy, whether it is tried for a document as it stands (n records so far), and whether equal counts don't replace.
ORDER = [
    ("bills", "fmt = 'eway_bill'"),
    ("lines", "fmt = 'gst2a' or n = 0"),
    ("blocks", "(fmt = 'gst2a' or open) and n < 3"),
    ("anchored", "(fmt = 'gst2a' or open) and n < 3"),
    ("rebuilt", "(fmt = 'gst2a' or open) and n < 3"),
    ("columns", "(fmt = 'gst2a' or open) and n < 3"),
    ("generic", "n < 3"),
]


def document_formats(lines: DataFrame) -> DataFrame:
    return parse.document_text(lines).select("doc_id", S.document_format("text").alias("fmt"))


def strategy(name: str, lines: DataFrame, boxes: DataFrame | None) -> DataFrame | None:
    if name == "columns":
        return None if boxes is None else parse.parse_columns(boxes)
    if name == "bills":
        return parse.parse_bills(lines, boxes)
    if name == "rebuilt":
        return parse.parse_rebuilt(lines, boxes is not None)
    return getattr(parse, f"parse_{name}")(lines)


def cascade(lines: DataFrame, boxes: DataFrame | None = None, lazily: bool = True) -> DataFrame:
    """Records (doc_id, ord, ..., strategy) of the strategy chosen for each document, deduplicated, places filled.

    A strategy is run over the documents that need it only; its records and the choices so far, one short row
    for each document, are written to the checkpoint folder between steps. Counts compared are before deduplication.
    With lazily=False all strategies run over all documents and the choice is made afterwards.
    """
    if lazily:  # read once; each strategy starts from what is written
        lines, boxes = checkpointed(lines), boxes if boxes is None else checkpointed(boxes)
    state = document_formats(lines).select("doc_id", "fmt", F.lit(0).cast("long").alias("n"), F.lit("").alias("chosen"), F.lit(False).alias("open"))
    found = []
    for name, tried in ORDER:
        if name == "lines":  # whether the line strategies are tried is settled here
            state = state.withColumn("open", F.col("n") == 0)
        ids = state.where(tried).select("doc_id")
        near = lambda df: df if df is None or not lazily else df.join(ids, "doc_id", "left_semi")  # noqa: B023, E731
        got = strategy(name, near(lines), near(boxes))
        if got is None:
            continue
        got = got.withColumn("strategy", F.lit(name))
        if lazily:
            got = checkpointed(got)
        found.append(got)
        count = got.groupBy("doc_id").agg(F.count("*").alias("_n"))
        better = F.expr(tried) & (F.coalesce("_n", F.lit(0)) > F.when(F.lit(name == "lines"), 0).otherwise(F.col("n")))
        state = state.join(count, "doc_id", "left").select("doc_id", "fmt", F.when(better, F.col("_n")).otherwise(F.col("n")).alias("n"), F.when(better, F.lit(name)).otherwise(F.col("chosen")).alias("chosen"), "open")
        if lazily:
            state = checkpointed(state)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    kept = every.join(state.select("doc_id", F.col("chosen").alias("strategy")), ["doc_id", "strategy"])
    out = deduplicated(kept)
    return out.withColumn("PLACE_OF_SUPPLY", F.when(F.col("PLACE_OF_SUPPLY") == "", S.state_name("GSTIN", C.IMAGE_STATES)).otherwise(F.col("PLACE_OF_SUPPLY")))
