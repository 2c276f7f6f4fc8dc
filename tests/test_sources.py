import zipfile

from pyspark.sql import functions as F

from slateledger.functions import constants as C
from slateledger.operators import parse
from slateledger.sources import ingest, sinks
from slateledger.streaming import jobs


def records(spark):
    li = spark.createDataFrame([(1, i, f"29ABCDE1234F1Z5 A&B <Co> INV-{100 + i} R 14-02-2024 1,180.00 1,000.00 180.00 Goa") for i in range(3)], "doc_id long, ord long, text string")
    return parse.parse_lines(li)


def test_guards_and_numbers(spark):
    files = spark.createDataFrame([("a/x_0012.PDF", 5), ("b.exe", 5), ("c.png", 200 << 20), ("noext", 1)], "path string, length long")
    assert [r.reason for r in ingest.guarded(files).collect()] == [None, "bad_extension", "too_large", "bad_extension"]
    assert files.select(ingest.file_number("path").alias("n")).first().n == "0012"


def test_kinds(spark):
    kinds = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf"), (3, "c.pdf"), (4, "d.jpg"), (5, "e.xyz")], "doc_id long, path string")
    pages = spark.createDataFrame([(1, 0, "x" * 250), (1, 1, None), (2, 0, "x" * 150), (2, 1, " "), (2, 3, "x" * 999)], "doc_id long, page_no int, text string")
    assert {r.doc_id: r.kind for r in ingest.classified(pages, kinds).collect()} == {1: "digital_pdf", 2: "photo_pdf", 3: "photo_pdf", 4: "image", 5: "image"}


def test_lines(spark):
    pages = spark.createDataFrame([(1, 0, "a\r\nb\n\nc\n"), (1, 1, ""), (1, 2, None)], "doc_id long, page_no int, text string")
    assert [(r.line_no, r.text) for r in ingest.exploded_lines(pages).collect()] == [(0, "a"), (1, "b"), (2, ""), (3, "c")]


def test_stream_order_rounds_half_to_even(spark):
    ch = spark.createDataFrame([(1, 0, 0, "a", 4.5), (1, 0, 1, "b", 7.6), (1, 0, 2, "c", 6.0), (1, 0, 3, "d", 4.4)], "doc_id long, page_no int, pos int, ch string, top double")
    assert {r.y: r.text for r in ingest.stream_order(ch).collect()} == {6: "ac", 9: "b", 3: "d"}


def test_html_cells():
    assert ingest.table_rows("<table><tr><th>A <b>x</b><td>1</tr><tr><td> 2\n3 </td></tr></table><p>no</p>") == [[["A x", "1"], ["2 3"]]]
    assert ingest.table_rows(None) == []


def test_reply(spark):
    own = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    got = lambda s: spark.range(1).select(ingest.merged_reply(own, F.lit(s)).alias("m")).first().m
    assert got('ok {"a": "9", "c": "3"} end') == {"a": "9", "b": "2", "c": "3"}
    assert got("none") == got("{broken") == {"a": "1", "b": "2"}


def test_training_entries_round_trip(spark, tmp_path):
    one = spark.createDataFrame([(1, "j", "f.pdf", "t", ["l1"])], "doc_id long, job_id string, source_file string, timestamp string, ocr_text array<string>")
    sinks.write_json(sinks.training_entries(records(spark), one), str(tmp_path / "raw"))
    (tmp_path / "raw" / "bad.json").write_text("{oops")
    (tmp_path / "raw" / "list.json").write_text('[{"job_id": "k", "record_count": 2}, {"job_id": "l"}]')
    got = {r.job_id: r for r in ingest.training_entries(spark, str(tmp_path / "raw")).collect()}
    assert set(got) == {"j", "k", "l"} and got["j"].record_count == 3 and got["j"].records[0]["INVOICE_NO"] == "INV-100"


def test_corrections(spark):
    old = records(spark).limit(1).withColumn("job_id", F.lit("j"))
    new = old.withColumn("IGST", F.lit("5"))
    entries = sinks.correction_entries(old, new, "t")
    assert entries.first().corrections == {"IGST": "5"}
    assert sinks.apply_corrections(old, entries).first().IGST == "5"


def test_workbook_and_export(spark, tmp_path):
    r = records(spark)
    assert sinks.write_workbook(r, str(tmp_path / "w.xlsx"), "June & July") == 3
    z = zipfile.ZipFile(tmp_path / "w.xlsx")
    data, summary = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/worksheets/sheet2.xml").decode()
    assert "A&amp;B &lt;Co&gt;" in data and "SUM(F4:F6)" in data and "₹3,540.00" in summary
    sinks.write_export(r, str(tmp_path / "x"), "csv", header="true")
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).columns == C.FIELDS


def test_states(spark):
    e = spark.createDataFrame([("a", 1, "queued", 0, ""), ("a", 2, "processing", 10, ""), ("a", 2, "complete", 100, "ok"), ("b", 1, "queued", 0, "")], "job_id string, ts long, status string, percent int, message string")
    assert {r.job_id: r.status for r in jobs.latest(e).collect()} == {"a": "complete", "b": "queued"}
    assert jobs.triggers(3, 9) == [5, 10] and jobs.triggers(5, 4) == []


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    (tmp_path / "in" / "b.exe").write_bytes(b"x")
    handle = lambda files, _: files.select(F.sha2("path", 256).alias("doc_id"))
    told = []
    jobs.run(jobs.arriving(spark, str(tmp_path / "in")), handle, str(tmp_path / "status"), str(tmp_path / "cp"), lambda *x: told.append(x)).awaitTermination()
    assert told == [(0, "processing", 10), (0, "complete", 100)]
    got = jobs.latest(spark.read.parquet(str(tmp_path / "status"))).collect()
    assert [(r.status, r.message.endswith("a.pdf")) for r in got] == [("complete", True)]


def test_local_jobs_with_the_services(spark):
    local = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "batch int, at int, file string")
    service = spark.createDataFrame([(1, 99, "s1"), (2, 1, "s2"), (2, 2, "s3")], "batch int, at int, job string")
    assert {(r.file, r.job) for r in jobs.paired(local, service, "batch", ["at"]).collect()} == {("a", "s1"), ("b", None), ("c", "s2")}


def test_entries_a_line_and_entries_in_files(spark, tmp_path):
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "a.json").write_text('[\n{"job_id": "1"},\n {"job_id": "2"}]')
    (tmp_path / "whole" / "b.json").write_text("{broken")
    assert sorted(r.job_id for r in ingest.training_entries(spark, str(tmp_path / "whole")).collect()) == ["1", "2"]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text('{"job_id": "1"}\n{"job_id": "2"}\nbroken\n')
    assert sorted(r.job_id for r in ingest.training_entries(spark, str(tmp_path / "lines"), multi_line=False).collect()) == ["1", "2"]


def test_places_looked_up_once(spark):
    from slateledger.functions.fuzzy import placed

    rows = spark.createDataFrame([(1, "to karnatka by road"), (2, "to karnatka by road"), (3, "in Goa"), (4, None), (5, "nowhere at all")], "n int, t string")
    assert {r.n: r.p for r in placed(rows, "t", "p").collect()} == {1: "Karnataka", 2: "Karnataka", 3: "Goa", 4: "", 5: ""}


def test_corrected_entries_need_no_join(spark, tmp_path):
    from slateledger.operators import report

    r = report.with_original(records(spark)).withColumn("IGST", F.lit("7")).withColumn("job_id", F.col("ord").cast("string"))
    old = r.select("job_id", *[F.col("_original")[f].alias(f) for f in C.FIELDS])
    got, want = (sorted((x.job_id, x.corrections, x.original_data) for x in df.collect()) for df in (sinks.corrected_entries(r, "s"), sinks.correction_entries(old, r.drop("_original"), "s")))
    assert [list(map(str, x)) for x in got] == [list(map(str, x)) for x in want] and got[0][1] == {"IGST": "7"}
    assert "Join" not in sinks.corrected_entries(r, "s")._jdf.queryExecution().optimizedPlan().toString()
    sinks.write_json(sinks.corrected_entries(r, "s"), str(tmp_path / "c"))
    assert {p.name.split(".", 1)[1] for p in (tmp_path / "c").glob("part-*")} == {"json.gz"}


def test_training_entries_gather_values_without_names(spark):
    jobs_ = spark.createDataFrame([(1, "j", "f.pdf", "t", ["l1"])], "doc_id long, job_id string, source_file string, timestamp string, ocr_text array<string>")
    got = sinks.training_entries(records(spark).withColumn("IGST", F.lit(None).cast("string")), jobs_)
    assert "to_json" not in got._jdf.queryExecution().optimizedPlan().toString()
    maps = got.first().records
    assert [m["INVOICE_NO"] for m in maps] == ["INV-100", "INV-101", "INV-102"] and set(maps[0]) == set(C.FIELDS) and maps[0]["IGST"] is None


def test_stretches_of_a_stream_are_cut_within_rows(spark):
    """The same rows as by characters, without a row for each character."""
    lines = [(1, 0, 0, "GSTIN 29"), (1, 0, 100, "ab"), (1, 0, 200, "cdefghij"), (1, 1, 0, "x"), (2, 0, 0, "yz")]
    top = lambda pos, i: (pos // 200) * 12.0 + (i * 7) % 5  # noqa: E731  stretches at 0 and 100 share heights
    chars = [(d, p, pos + i, c, top(pos, i)) for d, p, pos, t in lines for i, c in enumerate(t)]
    rows = [(d, p, pos, [(c, top(pos, i)) for i, c in enumerate(t)]) for d, p, pos, t in lines]
    want = ingest.stream_order(spark.createDataFrame(chars, "doc_id long, page_no int, pos long, ch string, top double")).collect()
    got = ingest.stream_order_of(spark.createDataFrame(rows, "doc_id long, page_no int, pos long, chars array<struct<ch:string,top:double>>"))
    assert sorted(got.collect()) == sorted(want)
