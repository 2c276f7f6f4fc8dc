import pytest
from pyspark.sql import functions as F

from slateledger.functions import constants as C
from slateledger.functions import scalars as S
from slateledger.functions.fuzzy import fuzzy_place


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def text(s):
    return F.lit(s)


@pytest.mark.parametrize(
    "fn,given,want",
    [
        (S.strict_id, "x 29ABCDE1234F1Z5 y", "29ABCDE1234F1Z5"),
        (S.strict_id, "29ABCDE1234F1Z55", ""),
        (S.any_id, "no 29ABCDE1234FAA9 here", "29ABCDE1234FAA9"),
        (S.valid_id, "29ABCDE1234F1Z5", True),
        (S.valid_id, "25ABCDE1234F1Z5", False),
        (S.valid_id, "29ABCDE1234FAZ5", True),
        (S.valid_id_calibration, "25ABCDE1234F1Z5", True),
        (S.valid_id_calibration, "29ABCDE1234FAZ5", False),
        (S.repair_id, "29A8CDEI2S4F1Z5", "29ABCDE1254F1Z5"),
        (S.repair_id, "29abcde1234f175", "29ABCDE1234F1Z5"),
        (S.repair_id, "short", "SHORT"),
        (S.clean_invoice, "INV-55962R14-02-2024", "INV-55962"),
        (S.invoice_date, "INV-55962R14-02-2024", "14-02-2024"),
        (S.clean_invoice, "INV-44734R", "INV-44734"),
        (S.clean_invoice, "inv-12/", "INV-12"),
        (S.first_real_amount, "5 12 1,180.00 900", "1,180.00"),
        (S.invoice_token, "ab 12 12345 999", "12345"),
        (S.place_contained, "to the goat market", "Goa"),
        (S.place_contained, "nowhere", ""),
        (S.display_name, "/a/9982a939-eca1-48dd-bce6-010bf8dee05d_June.v2.pdf", "June.v2"),
        (S.sanitised, "a b#c.pdf", "a_b_c.pdf"),
        (S.sanitised, "x" * 120 + ".pdf", "x" * 90 + ".pdf"),
        (S.norm_id, " 29abcde 1234f1z5x", "29ABCDE1234F1Z5"),
        (S.norm_amount, "1,180.50 ", 1180.5),
        (S.norm_amount, "n/a", 0.0),
        (S.norm_date, "14/02/2024", "14-02-2024"),
        (S.flat, " None ", ""),
        (S.rupees, "1234567.5", "₹1,234,567.50"),
        (S.rupees, "0", "₹0.00"),
        (S.header_line, "Invoice Number Invoice Date Taxable Value", True),
        (S.header_line, "page 3", True),
        (S.header_line, "  ", True),
        (S.header_line, "29ABCDE1234F1Z5 Acme 100.00", False),
        (S.bill_header_line, "E-Way Bill Register", True),
        (S.bill_header_line, "total " + "x" * 100, False),
    ],
)
def test_rules(spark, fn, given, want):
    assert value(spark, fn(text(given))) == want


@pytest.mark.parametrize("given,want", [("12345.67", ["67"]), ("10000", []), ("1,23,456.78", ["123456.78"]), ("5 12 9.99", ["12"])])
def test_image_amounts(spark, given, want):
    assert value(spark, S.image_amounts(text(given))) == want


def test_amount_grammar(spark):
    assert value(spark, S.every(text("1,23,456.78 and 500.00 x 12345.67"), C.AMOUNT)) == ["1,23,456.78", "500.00", "12345.67"]


@pytest.mark.parametrize("v,parts,want", [("7", ("1000", "180"), "1180.00"), ("1180", ("1000", "180"), "1180"), ("1", ("100", "0"), "1"), ("", ("1,000", "x"), "1000.00")])
def test_recalculated(spark, v, parts, want):
    assert value(spark, S.recalculated(text(v), *map(text, parts))) == want


@pytest.mark.parametrize("t,p,want", [("0", "0", True), ("0", "5", False), ("100", "100.5", True), ("100", "101", False)])
def test_amount_match(spark, t, p, want):
    assert value(spark, S.field_match("IGST", text(t), text(p))) is want


def test_exact_match_needs_a_value(spark):
    assert value(spark, S.field_match("INVOICE_NO", text(" inv-1"), text("INV-1 "))) is True
    assert value(spark, S.field_match("INVOICE_NO", text(""), text(""))) is False


@pytest.mark.parametrize("angles,want", [([1.0, 2.0, 9.0, 3.0], 2.0), ([0.1, 0.1, 0.1], 0.0), ([1.0, 2.0], 0.0), ([1.0, 2.0, 3.0, 4.0], 2.5)])
def test_deskew(spark, angles, want):
    assert value(spark, S.deskew_angle(F.array(*map(F.lit, angles)))) == want


def test_formats(spark):
    assert value(spark, S.document_format(text("E-Way Bill\nVehicle No"))) == "eway_bill"
    assert value(spark, S.document_format(text("GSTR-2A taxable value"))) == "gst2a"
    assert value(spark, S.document_format(text("123456789012 223456789012 323456789012"))) == "eway_bill"
    assert value(spark, S.document_format(text("nothing"))) == "unknown"
    assert value(spark, S.statement_format(text("purchase register"), F.lit(9))) == "ITC"
    assert value(spark, S.statement_format(text("x"), F.lit(2))) == "B"
    assert value(spark, S.statement_format(text("x"), F.lit(3))) == "A"


def test_fuzzy_place():
    assert fuzzy_place("to karnatka now") == "Karnataka"
    assert fuzzy_place("qqq zzz") == ""
    assert fuzzy_place(None) == ""


def test_grid_truncates(spark):
    assert value(spark, S.grid(F.lit(19.99), F.lit(100.0))) == 199
    assert value(spark, S.grid(F.lit(-3.0), F.lit(100.0))) == 0


def test_quality(spark):
    assert value(spark, S.quality_score(F.lit(500.0), F.lit(60.0), F.lit(185.0), F.lit(0.0))) == 1.0
    assert [value(spark, S.variant_count(F.lit(q))) for q in (0.75, 0.45, 0.44)] == [2, 4, 7]
