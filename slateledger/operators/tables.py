"""Records from tables of cells: headers decide the fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slateledger.functions import constants as C

# What a header must contain for its field (all words of one of the alternatives), in order of trial.
HEADERS = [
    ("GSTIN", [["gstin"]]), ("TRADE_NAME", [["trade"]]), ("INVOICE_NO", [["invoice", "no"]]), ("INVOICE_DATE", [["invoice", "date"]]), ("INVOICE_VALUE", [["invoice", "value"]]),
    ("TAXABLE_VALUE", [["taxable"]]), ("IGST", [["igst"], ["integrated"]]), ("CGST", [["cgst"], ["central"]]), ("SGST", [["sgst"], ["state"], ["utgst"]]), ("CESS", [["cess"]]),
    ("RETURN_PERIOD", [["return", "period"]]), ("PLACE_OF_SUPPLY", [["place", "supply"]]), ("TAX_RATE", [["rate"]]), ("REVERSE_CHARGE", [["reverse"]]), ("INVOICE_TYPE", [["type", "invoice"]]),
    ("SOURCE", [["source"]]), ("IRN_DATE", [["irn", "date"]]), ("IRN", [["irn"]]),
]


def header_field(header: Column) -> Column:
    """The field of a header, null for none."""
    low = F.lower(F.trim(header))
    cases = []
    for field, ways in HEADERS:
        hit = F.lit(False)
        for words in ways:
            every = F.lit(True)
            for w in words:
                every = every & F.contains(low, F.lit(w))
            hit = hit | every
        cases.append(F.when(hit, field))
    return F.coalesce(*cases)


def table_records(tables: DataFrame) -> DataFrame:
    """tables (doc_id, rows: array of arrays of cells, the first the header) to records with a GSTIN.

    The last column of a field counts; tables of one row and rows of blanks give none.
    """
    used = tables.where(F.size("rows") >= 2).select("doc_id", F.transform(F.get("rows", F.lit(0)), header_field).alias("fields"), F.posexplode(F.slice("rows", 2, 1 << 30)).alias("ord", "cells"))
    used = used.where(F.exists("cells", lambda c: c != ""))
    pairs = F.filter(F.arrays_zip("fields", "cells"), lambda p: p["fields"].isNotNull() & p["cells"].isNotNull())
    last = lambda f: F.try_element_at(F.filter("pairs", lambda p: p["fields"] == f), F.lit(-1))["cells"]
    got = used.select("doc_id", F.col("ord").cast("long").alias("ord"), pairs.alias("pairs"))
    defaults = {**C.DEFAULTS, "SOURCE": "table_extraction"}
    out = got.select("doc_id", "ord", *[F.coalesce(last(f), F.lit(defaults.get(f, ""))).alias(f) for f in [*C.FIELDS, "RETURN_PERIOD"]], F.lit(0.90).alias("_confidence"), F.lit("table_extraction").alias("_source"))
    return out.where("GSTIN <> ''")
