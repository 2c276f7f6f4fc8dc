"""Reports: export rows, totals, the summary sheet, source counts, confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateledger.functions import constants as C
from slateledger.functions import scalars as S


def totals(records: DataFrame) -> DataFrame:
    """Sums of the amount columns; what is no number is skipped, no rows give zero."""
    return records.agg(*[F.coalesce(F.sum(S.money(f)), F.lit(0).cast("decimal(25,2)")).alias(f) for f in C.AMOUNTS])


def summary(records: DataFrame) -> DataFrame:
    """One row: records, suppliers (a blank one counts), sums, tax, mean confidence in per cent."""
    sums = {f: F.coalesce(F.sum(S.money(f)), F.lit(0).cast("decimal(25,2)")) for f in C.AMOUNTS}
    got = records.agg(
        F.count("*").alias("records"), F.count_distinct(F.coalesce(S.flat("GSTIN"), F.lit(""))).alias("suppliers"), *[v.alias(f.lower()) for f, v in sums.items()],
        F.round(F.coalesce(F.avg(F.coalesce(F.col("_confidence").try_cast("double"), F.lit(0.0))) * 100, F.lit(0.0)), 6).alias("confidence"),
    )
    return got.withColumn("tax", F.col("igst") + F.col("cgst") + F.col("sgst") + F.col("cess"))


# The summary sheet's rows, with the column and note of each.
SHEET = [
    ("Total Invoice Records", "records", "Rows extracted"), ("Unique Suppliers", "suppliers", "Distinct GSTINs"), ("Total Invoice Value", "invoice_value", "Sum of all invoices"),
    ("Total Taxable Value", "taxable_value", "Taxable amount"), ("Total IGST", "igst", "Integrated GST"), ("Total CGST", "cgst", "Central GST"),
    ("Total SGST/UTGST", "sgst", "State/UT GST"), ("Total CESS", "cess", "Cess amount"), ("Total Tax Collected", "tax", "IGST+CGST+SGST+CESS"), ("Source Types", "sources", "E-Invoice/GSTR-1/Manual..."), ("OCR Accuracy", "accuracy", "Average confidence"),
]


def summary_sheet(records: DataFrame) -> DataFrame:
    """(pos, metric, value, note): the summary as rows of text."""
    cell = lambda c: F.col(c).cast("string") if c in ("records", "suppliers") else F.col(c) if c in ("sources", "accuracy") else S.rupees(c)
    sources = source_counts(records).agg(F.coalesce(F.max("rendered"), F.lit("—")).alias("sources"))
    row = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(m).alias("metric"), cell(c).alias("value"), F.lit(n).alias("note")) for i, (m, c, n) in enumerate(SHEET)]))
    whole = summary(records).withColumn("accuracy", F.format_string("%.1f%%", "confidence")).crossJoin(F.broadcast(sources))  # one row each
    return whole.select(row.alias("r")).select("r.*")


def source_counts(records: DataFrame) -> DataFrame:
    """(SOURCE, n, rendered): most frequent first, then first seen; rendered is the sheet's cell."""
    from pyspark.sql import Window

    counted = records.groupBy(S.flat("SOURCE").alias("SOURCE")).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "ord")).alias("_first"))
    pieces = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "_first", F.concat_ws(":", "SOURCE", F.col("n").cast("string")).alias("t"))).over(Window.partitionBy()))
    return counted.select("SOURCE", "n", F.array_join(F.transform(pieces, lambda x: x["t"]), ", ").alias("rendered"))


def document_confidence(docs: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, confidence): mean of the records', 0 for none."""
    return docs.select("doc_id").join(records.groupBy("doc_id").agg(F.avg("_confidence").alias("c")), "doc_id", "left").select("doc_id", F.round(F.coalesce("c", F.lit(0.0)), 6).alias("confidence"))


def routes(docs: DataFrame, records: DataFrame, enough: int = 3) -> DataFrame:
    """(doc_id, n, route): documents with enough records stay digital, the others go to recognition."""
    return docs.select("doc_id").join(records.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) >= enough, "digital").otherwise("image").alias("route"))


def with_original(records: DataFrame) -> DataFrame:
    """Records with their fields as they are now in `_original`, for changed() after they were rewritten."""
    return records.withColumn("_original", F.struct(*C.FIELDS))


def changed(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, changed): how many fields differ from `_original`."""
    return records.select(*keys, sum((F.when(~F.col("_original")[f].eqNullSafe(F.col(f)), 1).otherwise(0) for f in C.FIELDS), F.lit(0)).alias("changed"))


def corrections(original: DataFrame, corrected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, changed): how many fields differ between two tables."""
    return changed(with_original(original).select(*keys, "_original").join(corrected.select(*keys, *C.FIELDS), keys), keys)
