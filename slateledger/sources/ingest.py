"""Sources: files by kind and size, pages to lines, JSON entries, tables in HTML, replies in JSON."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slateledger.shipping import ship

# Accepted kinds and the largest size.
EXTENSIONS = [".pdf", ".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".webp", ".gif", ".heic", ".heif"]
MOST_BYTES = 100 * 1024 * 1024
DIGITAL_CHARS, DIGITAL_PAGES = 100, 3


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def guarded(files: DataFrame) -> DataFrame:
    """files (path, length, ...) with `reason`: null for accepted, bad_extension or too_large."""
    return files.withColumn("reason", F.when(~extension(F.col("path")).isin(EXTENSIONS), "bad_extension").when(F.col("length") > MOST_BYTES, "too_large"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of accepted kinds and sizes below a path, with their content."""
    return guarded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)).where("reason is null").drop("reason")


def classified(pages: DataFrame, kinds: DataFrame) -> DataFrame:
    """kinds (doc_id, path) with `kind`: digital_pdf if its first pages (pages: doc_id, page_no from 0, text) hold
    enough characters on average, photo_pdf if not or without pages, image for everything else."""
    own = pages.where(F.col("page_no") < DIGITAL_PAGES).groupBy("doc_id").agg(F.avg(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("_c"))
    ext = extension(F.col("path"))
    return kinds.join(own, "doc_id", "left").withColumn("kind", F.when(ext != ".pdf", "image").when(F.coalesce("_c", F.lit(0.0)) >= DIGITAL_CHARS, "digital_pdf").otherwise("photo_pdf")).drop("_c")


def exploded_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, text): lines of pages; a line end at the very end opens no further line."""
    cut = F.split(F.regexp_replace("text", r"(\r\n|\n|\r)$", ""), r"\r\n|\n|\r")
    return pages.where("text is not null and text <> ''").select("doc_id", "page_no", F.posexplode(cut).alias("line_no", "text"))


def stream_order(chars: DataFrame) -> DataFrame:
    """chars (doc_id, page_no, pos, ch, top) to (doc_id, page_no, y, text): characters by rounded height, in file order."""
    y = (F.bround(F.col("top") / 3, 0) * 3).cast("int")
    return chars.groupBy("doc_id", "page_no", y.alias("y")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("text"))


def stream_order_of(stretches: DataFrame) -> DataFrame:
    """The same of stretches (doc_id, page_no, pos, chars array<struct<ch, top>>) of a page's stream, which begin at pos and
    don't overlap. A stretch is cut by height within its row, so that no character becomes a row of its own."""
    at = F.transform("chars", lambda c: (F.rint(c["top"] / 3) * 3).cast("int"))
    seen = stretches.select("doc_id", "page_no", "pos", F.transform("chars", lambda c: c["ch"]).alias("_c"), at.alias("_y"))
    text = lambda y: F.array_join(F.filter("_c", lambda c, i: F.get("_y", i) == y), "")
    cut = seen.select("doc_id", "page_no", "pos", F.explode_outer(F.transform(F.array_distinct("_y"), lambda y: F.struct(y.alias("y"), text(y).alias("text")))).alias("p")).where("p is not null")
    pieces = F.array_sort(F.collect_list(F.struct("pos", "p.text")))
    return cut.groupBy("doc_id", "page_no", F.col("p.y").alias("y")).agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"))


TRAINING = "job_id string, source_file string, timestamp string, records array<map<string,string>>, ocr_text array<string>, record_count int"


def training_entries(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Entries of a folder of JSON files, a list in a file as its elements; files that can't be read are skipped.

    With multi_line=False files hold an entry a line, as sinks.write_json leaves them, and lines that can't
    be read are skipped.
    """
    got = spark.read.schema(TRAINING + ", _corrupt_record string").option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE").json(path)
    return got.where("_corrupt_record is null").drop("_corrupt_record")


def file_number(path: Column | str) -> Column:
    """The first four digits after an underscore in a file's name."""
    return F.regexp_extract(F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"^.*/", ""), r"_(\d{4})", 1)


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables, self.row, self.cell = [], None, None

    def close_cell(self):
        if self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.close_cell()
            self.row = []
            self.tables[-1].append(self.row)
        elif tag in ("td", "th") and self.row is not None:
            self.close_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()
        if tag in ("tr", "table"):
            self.row = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def table_rows(html: str | None) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(html or "")
    p.close_cell()
    return [t for t in p.tables if t]


@F.arrow_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def _html_tables(html: pa.Array) -> pa.Array:
    return pa.array([table_rows(h) for h in html.to_pylist()], pa.list_(pa.list_(pa.list_(pa.string()))))


def html_tables(html: Column | str) -> Column:
    """The tables of HTML texts, as rows of cells."""
    ship()
    return _html_tables(html)


def reply_fields(reply: Column | str) -> Column:
    """The fields of a reply's outermost braces; null if that is no JSON object."""
    text = F.regexp_extract(F.col(reply) if isinstance(reply, str) else reply, r"(?s)\{.*\}", 0)
    return F.from_json(F.nullif(text, F.lit("")), "map<string,string>")


def merged_reply(fields: Column | str, reply: Column | str) -> Column:
    """The original fields with the reply's in their place; as they were where there is no usable reply."""
    own = F.col(fields) if isinstance(fields, str) else fields
    got = F.coalesce(reply_fields(reply), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(got, k))
    return F.map_concat(kept, got)
