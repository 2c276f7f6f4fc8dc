"""Sinks: export tables, workbooks, training and correction entries, reports as JSON."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateledger.functions import constants as C
from slateledger.functions import scalars as S
from slateledger.operators import report
from slateledger.operators.records import flatten

# Fixed value: a sheet's most rows.
SHEET_ROWS = 1_048_576


def write_export(records: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    """Export rows in contract order, as many files as there are partitions."""
    flatten(records).select(*C.FIELDS).write.mode("errorifexists").format(kind).options(**options).save(path)


def workbook_name(path: str, stamp: str, job_id: str, prefix: str = "GST2A") -> F.Column:
    """<prefix>_<display name>_<time>_<first eight of the job>.xlsx"""
    return F.concat_ws("_", F.lit(prefix), S.display_name(F.lit(path)), F.lit(stamp), F.concat(F.substring(F.lit(job_id), 1, 8), F.lit(".xlsx")))


def _cell(ref: str, value: object) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    if str(value).startswith("=SUM("):
        return f'<c r="{ref}"><f>{escape(str(value)[1:])}</f></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape("".join(c for c in str(value) if c >= " " or c in chr(9) + chr(10)))}</t></is></c>'


def _column(i: int) -> str:
    return (chr(64 + i // 26) if i // 26 else "") + chr(65 + i % 26)


def write_workbook(records: DataFrame, path: str, title: str) -> int:
    """One workbook on the driver: a data sheet with totals of the amounts, and a summary sheet.

    Rows are streamed; a table that has more than a sheet holds is refused, not cut. Returns the rows.
    """
    n = records.count()
    if n > SHEET_ROWS - 4:
        raise ValueError(f"{n} rows do not fit a sheet; use write_export")
    row = lambda r, values: f'<row r="{r}">' + "".join(_cell(f"{_column(i)}{r}", v) for i, v in enumerate(values)) + "</row>"
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    panes = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="3" topLeftCell="A4" state="frozen"/></sheetView></sheetViews>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?>\n<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/worksheets/sheet2.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?>\n<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?>\n<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Summary" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?>\n<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet2.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write((head + panes + "<sheetData>" + row(1, [title]) + row(2, [f"{n} records"]) + row(3, C.TITLES)).encode())
            for k, r in enumerate(flatten(records).orderBy("doc_id", "ord").select(*C.FIELDS).toLocalIterator(), 4):
                f.write(row(k, r).encode())
            sums = [f"=SUM({_column(i)}4:{_column(i)}{n + 3})" if x in C.AMOUNTS else "TOTAL" if i == 0 else "" for i, x in enumerate(C.FIELDS)]
            f.write((row(n + 4, sums) + f'</sheetData><autoFilter ref="A3:{_column(len(C.FIELDS) - 1)}{n + 3}"/></worksheet>').encode())
        lines = [("Metric", "Value", "Notes"), *((r.metric, r.value, r.note) for r in report.summary_sheet(records).orderBy("pos").collect())]
        z.writestr("xl/worksheets/sheet2.xml", head + "<sheetData>" + "".join(row(k, v) for k, v in enumerate(lines, 1)) + "</sheetData></worksheet>")
    return n


def training_entries(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs (doc_id, job_id, source_file, timestamp, ocr_text) to entries, one for each job."""
    names = F.array(*map(F.lit, C.FIELDS))
    cells = F.array(*[F.col(f) for f in C.FIELDS])  # named after they are gathered
    own = records.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", cells.alias("c")))), lambda x: F.map_from_arrays(names, x["c"])).alias("records"))
    got = jobs.join(own, "doc_id", "left").withColumn("records", F.coalesce("records", F.array().cast("array<map<string,string>>")))
    return got.select("job_id", "source_file", "timestamp", "records", "ocr_text", F.size("records").alias("record_count"))


def write_json(rows: DataFrame, path: str) -> None:
    """Training, correction or calibration entries, appended as JSON lines, compressed: their field names repeat."""
    rows.write.mode("append").option("compression", "gzip").json(path)


def correction_entries(original: DataFrame, corrected: DataFrame, stamp: str) -> DataFrame:
    """(job_id, field maps) with the fields that were changed, and the original ones."""
    fields = lambda df, name: df.select("job_id", F.struct(*C.FIELDS).alias(name))
    return corrected_entries(fields(original, "_original").join(fields(corrected, "_new"), "job_id").select("job_id", "_original", "_new.*"), stamp)


def corrected_entries(records: DataFrame, stamp: str) -> DataFrame:
    """The same of records that have their fields as they were in `_original` (report.with_original), without a join."""
    maps = lambda c: F.map_from_arrays(F.array(*map(F.lit, C.FIELDS)), F.array(*[c(f) for f in C.FIELDS]))
    changed = F.map_from_entries(F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col("_original")[f]), F.struct(F.lit(f).alias("key"), F.col(f).alias("value"))) for f in C.FIELDS]), lambda e: e.isNotNull()))
    return records.select("job_id", changed.alias("corrections"), maps(lambda f: F.col("_original")[f]).alias("original_data"), F.lit(stamp).alias("timestamp"))


def apply_corrections(original: DataFrame, entries: DataFrame) -> DataFrame:
    """Beyond the reference: the latest correction of each job merged into its record."""
    last = entries.groupBy("job_id").agg(F.max_by("corrections", "timestamp").alias("_c"))
    return original.join(last, "job_id", "left").select("job_id", *[F.coalesce(F.col("_c")[f], F.col(f)).alias(f) for f in C.FIELDS])


def calibration_report(accuracy: DataFrame, fields: DataFrame) -> DataFrame:
    """One JSON text: accuracy by format and by field."""
    pack = lambda df, key: df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.struct(*[c for c in df.columns if c != key])))).alias("m"))
    return pack(accuracy, "fmt").withColumnRenamed("m", "a").crossJoin(pack(fields, "field").withColumnRenamed("m", "f")).select(F.to_json(F.struct(F.col("a").alias("per_format"), F.col("f").alias("per_field"))).alias("report"))  # two rows
