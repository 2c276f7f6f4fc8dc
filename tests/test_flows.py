from pyspark.sql import functions as F

from slateledger.operators import report
from slateledger.plans import flows, render
from slateledger.plans.queries import pages, split_lines
from slateledger.sources import plugins

G = "29ABCDE1234F1Z5"


class Engine:
    available = True

    def extract_text(self, content):
        if content == b"bad":
            raise ValueError
        text = content.decode()
        return {"lines": [{"text": t, "confidence": 0.9, "bbox": [0, 30 * i, 100, 30 * i + 10] if i % 2 else [[0, 30 * i], [100, 30 * i + 10]]} for i, t in enumerate(text.split("\n"))], "avg_confidence": 0.9}


def test_digital_flow_parses_every_format(spark, sf):
    inv = render.invoices(spark, sf).where("code <> '25' and doc_id < 9")
    register, wide = (pages(render.lines(inv, k)).withColumn("text", F.concat(F.when(F.col("page_no") == 0, head).otherwise(""), "text")) for k, head in (("register", "purchase register\n"), ("wide", "invoice no taxable value\n")))
    split = pages(split_lines(inv)).groupBy("doc_id", "page_no").agg(F.first("text").alias("text"))
    some = lambda df, k: df.where(F.col("doc_id") % 2 == k).select("doc_id", F.col("page_no").cast("int").alias("page_no"), "text")
    for df in (register, wide):
        got = flows.digital(some(df, 0))
        assert got.count() == inv.where("doc_id % 2 = 0").count()
        assert got.where("PLACE_OF_SUPPLY = ''").count() == 0
    groups = split.withColumn("text", F.regexp_replace("text", "GSTIN of supplier Invoice Number", "Supplier GSTIN list"))
    assert {r.fmt for r in flows.statement_formats(groups).collect()} <= {"A", "B"}
    assert {r.route for r in flows.digital_routes(some(register, 0)).collect()} == {"digital"}


def test_image_flow_with_a_plug_in_engine(spark):
    full = "\n".join(f"{G} Acme INV-{100 + i} R 14-02-2024 1,180.00 1,000.00 180.00 Goa" for i in range(3))
    odd = "ids 29ABCDE1234FAA9 seen for 9.50"
    files = spark.createDataFrame([("a", full.encode()), ("b", odd.encode()), ("c", b"bad")], "path string, content binary")
    images = plugins.converted(files, "convert", lambda: lambda path, content: [(0, 0, content), (0, 1, b"bad")])
    results = plugins.recognised(images, "fake", 0, Engine)
    got = {}
    for r in flows.image(results).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {"a", "b"} and len(got["a"]) == 3 and {r.PLACE_OF_SUPPLY for r in got["a"]} == {"Goa"}
    assert [(r._source, r.INVOICE_VALUE) for r in got["b"]] == [("image_emergency_regex", "9.50")]
    assert report.totals(flows.image(results).where("doc_id = 'a'")).first().IGST == 540


def test_validator_keeps_what_it_fails_on(spark):
    rec = spark.createDataFrame([("x", "1", "s"), ("y", "2", "s")], "GSTIN string, IGST string, sample string")

    def make():
        def check(record, text):
            return {"IGST": "9", "new": "z"} if record["GSTIN"] == "x" else 1 / 0

        return check

    assert [tuple(r) for r in plugins.validated(rec, "v", make).collect()] == [("x", "9", "s"), ("y", "2", "s")]


def test_labelled_fields(spark):
    t = [(1, 0, "29A", "B-GSTIN"), (1, 1, "BC", "I-GSTIN"), (1, 2, "x", "O"), (1, 3, "7", "B-IGST"), (1, 4, "8", "B-IGST"), (1, 5, "9", "I-CGST")]
    got = plugins.labelled_fields(spark.createDataFrame(t, "doc_id long, pos int, token string, label string"))
    assert got.first().fields == {"GSTIN": ["29A BC"], "IGST": ["7", "8"], "CGST": ["9"]}
    assert got.select(plugins.first_values("fields").alias("f")).first().f == {"GSTIN": "29A BC", "IGST": "7", "CGST": "9"}


def test_corners():
    assert plugins.corners([0, 1, 2, 3]) == [[0, 1], [2, 1], [2, 3], [0, 3]]
    assert plugins.corners([[0, 0], [1, 1]]) == [[0, 0], [1, 1]]
    assert plugins.corners("no") is plugins.corners([1]) is plugins.corners([1, 2]) is None
