import pytest

from slateledger.operators import cascade, evaluate, ocr, parse, records, report
from slateledger.operators.tables import table_records


def lines(spark, *docs):
    return spark.createDataFrame([(d, 0, i, t) for d, own in enumerate(docs) for i, t in enumerate(own)], "doc_id long, page_no int, ord long, text string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def has(record, **want):
    assert {k: record[k] for k in want} == want


G = "29ABCDE1234F1Z5"


def test_image_line(spark):
    r = one(parse.parse_lines(lines(spark, [f"12 {G} Acme Traders INV-1001 R 14-02-2024 1,180.00 1,000.00 180.00 Karnataka", "too short"])))
    has(r, GSTIN=G, TRADE_NAME="Acme Traders", INVOICE_NO="INV-1001", INVOICE_TYPE="R", INVOICE_DATE="14-02-2024", INVOICE_VALUE="1180.00", TAXABLE_VALUE="1000.00", IGST="180.00", PLACE_OF_SUPPLY="Karnataka", TAX_RATE="", REVERSE_CHARGE="N", _confidence=0.80)


def test_register_line(spark):
    r = one(parse.parse_register(lines(spark, [f"14-02-2024 1001 Acme Traders {G} 1,000.00 180.00 0.00 0.00 0.00 1,180.00", "Grand Total", "14-02-2024 no number"])))
    has(r, INVOICE_NO="1001", TRADE_NAME="Acme Traders", TAXABLE_VALUE="1000.00", IGST="180.00", CGST="0.00", SGST="0.00", CESS="0.00", INVOICE_VALUE="1180.00", PLACE_OF_SUPPLY="Karnataka", SOURCE="ITC Register", _confidence=0.95)


@pytest.mark.parametrize(
    "line,want",
    [
        (f"7 Acme {G} INV-44734R 14-02-2024 1,180.00 Karnataka N 18 1,000.00 180.00 0 0 0 Y 11-Feb-24 Feb-24 Y N Manual", {"INVOICE_NO": "INV-44734", "TRADE_NAME": "7 Acme", "INVOICE_DATE": "14-02-2024", "INVOICE_VALUE": "1180.00", "PLACE_OF_SUPPLY": "Karnataka", "TAX_RATE": "18", "TAXABLE_VALUE": "1000.00", "IGST": "180.00", "GSTR1_STATUS": "Y", "GSTR1_FILING_DATE": "11-Feb-24", "GSTR1_PERIOD": "Feb-24", "GSTR3B_STATUS": "Y", "SOURCE": "Manual"}),
        (f"3 Acme Traders 12345 {G} 14-02-2024 7 1,180.00 Goa Y 5", {"INVOICE_NO": "12345", "TRADE_NAME": "Acme Traders", "INVOICE_VALUE": "1180.00", "PLACE_OF_SUPPLY": "Goa", "REVERSE_CHARGE": "Y", "TAX_RATE": "5"}),
        (f"Acme {G} 2024 98765 14-02-2024 500", {"INVOICE_NO": "98765", "TRADE_NAME": "Acme", "PLACE_OF_SUPPLY": "Karnataka", "INVOICE_VALUE": "500"}),
        (f"Acme {G} INV/9 14-02-2024 500.00 Goa N 0 1.00 2.00 3.00 4.00 5.00 N 01-Jan-24 Jan-24 N Y Mar-23 15-03-2024 E-Invoice {'ab' * 32} 16-03-2024", {"AMENDMENT": "Y", "TAX_PERIOD_AMENDED": "Mar-23", "CANCEL_DATE": "15-03-2024", "SOURCE": "E-Invoice", "IRN": "ab" * 32, "IRN_DATE": "16-03-2024", "CESS": "5.00"}),
    ],
)
def test_wide_line(spark, line, want):
    has(one(parse.parse_wide(lines(spark, [line]))), **want)


def test_bill_line(spark):
    li = lines(spark, [f"from {G}", "123456789012 14-02-2024 1,000.00 90.00 90.00 18.00 1,198.00 Goa Road Active", "E-Way Bill Register"])
    r = {x.INVOICE_NO: x.asDict() for x in parse.parse_bills(li).collect()}["123456789012"]
    has(r, GSTIN=G, TAXABLE_VALUE="1000.00", IGST="90.00", CGST="90.00", SGST="18.00", INVOICE_VALUE="1198.00", INVOICE_TYPE="Road", GSTR1_STATUS="Active", PLACE_OF_SUPPLY="Goa")


@pytest.mark.parametrize("amounts,want", [("50.00", ("", "", "50.00")), ("50.00 60.00", ("50.00", "", "60.00")), ("50.00 60.00 70.00", ("50.00", "60.00", "70.00"))])
def test_generic_line(spark, amounts, want):
    r = one(parse.parse_generic(lines(spark, [f"entry of 2/2/01 is {amounts}", "entry without any figures", "total 14-02-2024 50.00"])))
    assert (r["TAXABLE_VALUE"], r["IGST"], r["INVOICE_VALUE"]) == want


def test_rebuilt_from_tokens_repeats_and_dedupes(spark):
    li = lines(spark, ["29ABCDE 1234F1Z5 INV-77 14-02-2024 1,180.00"])
    got = parse.parse_rebuilt(li)
    assert got.count() == 4 and {r.GSTIN for r in got.collect()} == {G}
    assert records.deduplicated(got).count() == 1


def test_row_clusters_compare_with_the_first_box(spark):
    boxes = spark.createDataFrame([(1, i, t, x, y) for i, (t, x, y) in enumerate([("b", 2.0, 15.0), ("a", 1.0, 0.0), ("c", 1.0, 25.0), ("d", 1.0, 45.0), (" ", 0.0, 0.0)])], "doc_id long, pos int, text string, xc double, yc double")
    assert [r.text for r in parse.row_clusters(boxes).orderBy("ord").collect()] == ["a b", "c", "d"]


def test_split_groups(spark):
    pages = [["GSTIN Invoice Number", f"{G} Acme INV-9R 14-02-2024 1,180.00 Goa N 18", "27ABCDE1234F1Z5 Other 4321 14-02-2024 500"], ["Taxable Value Central Tax", "1,000.00 180.00 0 Y 11-Feb-24 Feb-24 N"], ["Amendment IRN", "N N/A 15-03-2024 IFF", "Y Mar-23 N/A GSTR-1 " + "0f" * 32]]
    li = spark.createDataFrame([(1, p, p * 100 + i, t) for p, own in enumerate(pages) for i, t in enumerate(own)], "doc_id long, page_no int, ord long, text string")
    a, b = (r.asDict() for r in parse.parse_split(li).orderBy("ord").collect())
    has(a, GSTIN=G, INVOICE_NO="INV-9", TRADE_NAME="Acme", TAXABLE_VALUE="1000.00", GSTR3B_STATUS="N", CANCEL_DATE="15-03-2024", SOURCE="IFF")
    has(b, INVOICE_NO="4321", TAXABLE_VALUE="", GSTR1_STATUS="", AMENDMENT="Y", TAX_PERIOD_AMENDED="Mar-23", IRN="0f" * 32)


def test_zip_has_defaults_and_normalises(spark):
    side = lambda n, fields: spark.createDataFrame([(1, i, *(f"{f}{i}" for f in fields)) for i in range(n)], "doc_id long, ord long, " + ", ".join(f"{f} string" for f in fields))
    from slateledger.functions.constants import FIELDS

    got = parse.zip_groups(side(2, FIELDS[:9]), side(3, FIELDS[9:18]), side(1, FIELDS[18:])).orderBy("ord").collect()
    assert len(got) == 3 and got[2].GSTIN is None and got[1].SOURCE == "Unknown" and got[2].IGST == "IGST2"
    last = records.normalise(parse.zip_groups(side(2, FIELDS[:9]), side(3, FIELDS[9:18]), side(1, FIELDS[18:]))).orderBy("ord").collect()[2]
    assert last.GSTIN == "" and last.INVOICE_TYPE == "R"


def full(i):
    return f"{G} Acme INV-{100 + i} R 14-02-2024 1,180.00 1,000.00 180.00 Goa"


CASCADE = {
    "lines": [full(1), full(2), full(3)],
    "blocks": [f"to {full(1)}", f"to {full(2)}", full(3)],
    "bills": ["e-way bill and vehicle no of all the consignments in the long list below this line, which is long enough", "123456789012 14-02-2024 1,000.00", "123456789013 14-02-2024 1,000.00", "123456789014 14-02-2024 1,000.00"],
    "generic": ["e-way bill and vehicle no of all the consignments in the long list below this line, which is long enough", "123456789012 14-02-2024 1,000.00", "entry of 14-02-2024 is 50.00", "entry of 15-02-2024 is 60.00"],
}


def test_cascade_choices_lazy_equals_eager(spark):
    li = lines(spark, *CASCADE.values(), ["nothing to see here at all"])
    lazy = cascade.cascade(li)
    chosen = {r.doc_id: r.strategy for r in lazy.select("doc_id", "strategy").distinct().collect()}
    assert chosen == dict(enumerate(CASCADE))
    assert sorted(map(str, lazy.collect())) == sorted(map(str, cascade.cascade(li, lazily=False).select(lazy.columns).collect()))


def test_dedupe_keeps_first_and_blanks_and_is_idempotent(spark):
    rows = [(1, i, g, n) for i, (g, n) in enumerate([("a", "1"), ("a", "1"), ("", ""), ("", ""), ("a", "")])]
    got = records.deduplicated(spark.createDataFrame(rows, "doc_id long, ord long, GSTIN string, INVOICE_NO string"))
    assert sorted(r.ord for r in got.collect()) == [0, 2, 3, 4]
    assert records.deduplicated(got).count() == 4


def test_emergency(spark):
    docs = spark.createDataFrame([(1, f"{G} 14-02-2024 10.50 20.5 27ABCDE1234F1Z5 30.00")], "doc_id long, text string")
    a, b = parse.emergency(docs).orderBy("ord").collect()
    assert (a.INVOICE_DATE, a.INVOICE_VALUE, a.TAXABLE_VALUE, a.INVOICE_NO) == ("14-02-2024", "10.50", "20.5", "UNKNOWN-1")
    assert (b.INVOICE_DATE, b.INVOICE_VALUE, b.TAXABLE_VALUE) == ("", "30.00", "")


def test_header_mapping_last_column_wins(spark):
    t = spark.createDataFrame([(1, [["GSTIN", "IRN", "IRN date", "State tax", "Invoice No", "invoice note"], ["g", "i", "d", "9", "1", "2"], ["", "", "", "", "", ""]]), (2, [["GSTIN"]])], "doc_id long, rows array<array<string>>")
    has(one(table_records(t)), GSTIN="g", IRN="i", IRN_DATE="d", SGST="9", INVOICE_NO="2", SOURCE="table_extraction", _confidence=0.90)


def test_last_truth_wins_and_predictions_repeat(spark):
    cols = ["GSTIN", "INVOICE_NO", "INVOICE_DATE", "INVOICE_VALUE", "TAXABLE_VALUE", "IGST", "CGST", "SGST"]
    row = lambda o, n: ("f", o, G, n, "1-1-24", "100", "100", "0", "0", "0")
    make = lambda *r: spark.createDataFrame(list(r), "file_num string, ord long, " + ", ".join(f"{c} string" for c in cols))
    truth, predicted = make(row(1, "A"), row(2, "B")), make(row(1, "b"), row(2, "b"), row(3, "A"))
    got = evaluate.matches(truth, predicted, ["file_num"]).where("field = 'INVOICE_NO'").orderBy("ord").collect()
    assert [r.match for r in got] == [True, True, False]
    assert evaluate.detection(truth, predicted, ["file_num"]).first().rate == 1.5


@pytest.mark.parametrize("rates,want", [([0.5, 0.9, 0.9, 0.2], 2), ([0.5, 0.96, 0.99], 2), ([0.0, 0.0], None)])
def test_best_epoch(spark, rates, want):
    got = evaluate.best_epoch(spark.createDataFrame(list(enumerate(rates, 1)), "epoch int, rate double")).collect()
    assert [r.epoch for r in got] == ([want] if want else [])


def test_best_result_takes_the_first_of_equals(spark):
    rows = [(1, 0, 1, 0.5, 4), (1, 0, 0, 0.5, 4), (1, 1, 0, 0.5, 4), (1, 2, 2, 0.2, 0)]
    r = ocr.best_results(spark.createDataFrame(rows, "page int, variant_ord int, engine_ord int, confidence double, line_count int"), ["page"]).first()
    assert (r.variant_ord, r.engine_ord, r.score) == (0, 0, 1.0)


def test_word_lines(spark):
    w = [(1, 0, "a", 90, 1, 0, 5, 10, 8), (1, 1, " ", 90, 2, 0, 0, 1, 1), (1, 2, "b", 70, 1, 20, 4, 10, 9), (1, 3, "x", -1, 2, 0, 0, 1, 1), (1, 4, "c", 50, 2, 3, 30, 5, 5), (1, 5, "d", 50, 1, 1, 1, 1, 1)]
    got = ocr.word_lines(spark.createDataFrame(w, "doc_id long, pos int, text string, conf int, line_num int, left int, top int, width int, height int")).orderBy("line").collect()
    assert [(r.text, r.conf, r.x0, r.y0, r.x1, r.y1) for r in got] == [("a b", 80.0, 0, 5, 30, 13), ("c", 50.0, 3, 30, 8, 35), ("d", 50.0, 1, 1, 2, 2)]


def test_sums_of_nothing_are_zero(spark):
    empty = parse.parse_lines(lines(spark, ["x"]))
    assert report.totals(empty).first().IGST == 0 and report.summary(empty).first().suppliers == 0
