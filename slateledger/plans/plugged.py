"""Queries through plug-ins: rendered pages to a recognition engine, tokens with labels, a validator. The engines here are
deterministic, so that what comes out is known."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateledger.functions import constants as C
from slateledger.plans import flows, oracle, render
from slateledger.sources import plugins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return add


class TextEngine:
    """Reads pages whose content is their text, a box of ten units a word and 30 a line; pages that begin with a question
    mark are read badly, and some can't be read at all."""

    available = True

    def extract_text(self, content: bytes) -> dict:
        text = content.decode()
        if text.startswith("!"):
            raise ValueError("no page")
        good = not text.startswith("?")
        lines = []
        for k, t in enumerate(text.lstrip("?").split("\n")):
            y = 30 * k
            lines.append({"text": t if good else t[::-1], "confidence": 0.9, "bbox": [0, y, 100, y + 10] if k % 2 else [[0, y], [100, y], [100, y + 10], [0, y + 10]]})
        return {"lines": lines, "avg_confidence": 0.9 if good else 0.3}


def split_page(path: str, content: bytes) -> list[tuple[int, int, bytes]]:
    """Three variants of each page of a file: unreadable, bad and good."""
    return [(p, v, mark + page) for p, page in enumerate(content.split(b"\f")) for v, mark in enumerate((b"!", b"?", b""))]


_FOUND = ["doc_id", "GSTIN", "INVOICE_NO", "INVOICE_VALUE", "TAXABLE_VALUE", "PLACE_OF_SUPPLY", "_source"]


@query("q_image_flow", f"SELECT {', '.join(_FOUND)} FROM ({oracle.cascade_records(render.sql('image'))}) z")
def q_image_flow(spark, d):
    """Files to page images, three variants each, an engine, the best result of each page, and the cascade."""
    lines = render.lines(render.invoices(spark, d), "image")
    page = lines.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("t"))
    files = page.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "t"))), lambda x: x["t"]), "\f").alias("t"))
    images = plugins.converted(files.select(F.col("doc_id").cast("string").alias("path"), F.encode("t", "UTF-8").alias("content")), "pages", lambda: split_page)
    got = flows.image(plugins.recognised(images, "text", 0, TextEngine))
    return got.withColumn("doc_id", F.col("doc_id").cast("long")).select(*_FOUND)


@query("q_labelled_fields", f"{render.sql()} SELECT doc_id, CAST(ord AS BIGINT) AS ord, gstin AS GSTIN, name AS TRADE_NAME, concat('INV-', okey) AS INVOICE_NO, CAST(value AS STRING) AS INVOICE_VALUE, 2 AS amounts FROM inv")
def q_labelled_fields(spark, d):
    """Tokens with labels, as a layout model gives them, to fields: runs joined, the first value of each."""
    inv = render.invoices(spark, d)
    key = F.concat_ws("-", "doc_id", "ord")
    name = F.transform(F.split("name", " "), lambda t, i: F.struct(t.alias("token"), F.when(i == 0, "B-TRADE_NAME").otherwise("I-TRADE_NAME").alias("label")))
    one = lambda c, label: F.struct(c.cast("string").alias("token"), F.lit(label).alias("label"))
    head = F.array(one(F.substring("gstin", 1, 7), "B-GSTIN_"), one(F.lit("x"), "O"), one(F.col("gstin"), "B-GSTIN"))
    rest = F.array(one(F.lit("of"), "O"), one(F.concat(F.lit("INV-"), "okey"), "B-INVOICE_NO"), one(F.col("value"), "B-INVOICE_VALUE"), one(F.col("taxable"), "B-INVOICE_VALUE"))
    tokens = inv.select(key.alias("doc_id"), F.posexplode(F.concat(head, name, rest)).alias("pos", "t")).select("doc_id", "pos", "t.token", "t.label")
    got = plugins.labelled_fields(tokens).select("doc_id", "fields", plugins.first_values("fields").alias("f"))
    at = F.split("doc_id", "-")
    return got.select(at[0].cast("long").alias("doc_id"), at[1].cast("long").alias("ord"), *[F.col("f")[c].alias(c) for c in ("GSTIN", "TRADE_NAME", "INVOICE_NO", "INVOICE_VALUE")], F.size(F.col("fields")["INVOICE_VALUE"]).alias("amounts"))


def make_check() -> Callable[[dict, str], dict]:
    """A validator that takes the state's place and drops amounts of nothing; it fails on records of one rate."""

    def check(record: dict, sample: str) -> dict:
        if record["TAX_RATE"] == "28":
            raise ValueError(sample)
        return {"PLACE_OF_SUPPLY": C.PDF_STATES.get(record["GSTIN"][:2], "") or sample[:3], "IGST": "" if record["IGST"] == "0.00" else record["IGST"], "unknown": "x"}

    return check


@query(
    "q_validated_records",
    f"{render.sql()} SELECT doc_id, CAST(ord AS BIGINT) AS ord, gstin AS GSTIN, rate AS TAX_RATE, CASE WHEN rate = '28' THEN 'old' WHEN pos <> '' THEN pos ELSE substring(name, 1, 3) END AS PLACE_OF_SUPPLY, "
    "CASE WHEN rate <> '28' AND igst = 0 THEN '' ELSE CAST(igst AS STRING) END AS IGST FROM inv",
)
def q_validated_records(spark, d):
    """Records through a validator, which fails on some: those stay as they are."""
    records = render.invoices(spark, d).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("gstin").alias("GSTIN"), F.col("rate").alias("TAX_RATE"), F.lit("old").alias("PLACE_OF_SUPPLY"), F.col("igst").cast("string").alias("IGST"), F.col("name").alias("sample"))
    return plugins.validated(records, "check", make_check).drop("sample")
