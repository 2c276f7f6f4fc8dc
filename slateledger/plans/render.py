"""Statement lines rendered from the driver's tables: the tables hold no statements of their own.

Each lineitem becomes an invoice of its supplier; a document holds the invoices of 32 order keys, so that
documents grow in number with the data, not in size. The SQL renders the same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateledger.functions import constants as C
from slateledger.operators.records import settled

TIES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"


_CASE = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.PDF_STATES.items()) + " ELSE '' END"
_MAP = "coalesce(try_element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in C.PDF_STATES.items()) + "), code), '')"


def _base(date: str, commas: str, states: str) -> str:
    """The invoices, in SQL that both engines read but for the two formats."""
    return f"""
SELECT doc_id, ord, page_no, gstin, code, name, okey, inv_date, taxable, igst, half, CAST(taxable + igst + half + half AS DECIMAL(15,2)) AS value,
       {states} AS pos, rate, rc, parity, prio
FROM (SELECT *, substring(gstin, 1, 2) AS code, CAST(floor((ord - 1) / 40) AS INT) AS page_no FROM (
  SELECT CAST(floor(l_orderkey / 32) AS BIGINT) AS doc_id,
         row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 32) AS BIGINT) ORDER BY {TIES}) AS ord,
         concat(lpad(CAST(s_nationkey + 1 AS STRING), 2, '0'), translate(lpad(CAST(s_suppkey % 100000 AS STRING), 5, '0'), '0123456789', 'ABCDEFGHIJ'), lpad(CAST(s_suppkey % 10000 AS STRING), 4, '0'), 'F1Z5') AS gstin,
         concat('Acme ', translate(lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0'), '0123456789', 'ABCDEFGHIJ'), ' Traders') AS name,
         CAST(l_orderkey + 10000 AS STRING) AS okey, {date} AS inv_date, CAST(l_extendedprice AS DECIMAL(15,2)) AS taxable,
         CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(15,2)) ELSE CAST(0 AS DECIMAL(15,2)) END AS igst,
         CASE WHEN l_linenumber % 2 = 1 THEN CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_tax AS DECIMAL(4,2)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(15,2)) ELSE CAST(0 AS DECIMAL(15,2)) END AS half,
         CASE l_linenumber % 5 WHEN 0 THEN '0' WHEN 1 THEN '5' WHEN 2 THEN '12' WHEN 3 THEN '18' ELSE '28' END AS rate,
         CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS rc, CAST(l_linenumber % 2 AS INT) AS parity, CAST(l_linenumber AS INT) AS prio
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) x) y
"""


#: How the two engines write a date, a grouped amount and a lookup (one literal map, as plans repeat it).
SPARK = {"date": "date_format(l_shipdate, 'dd-MM-yyyy')", "commas": "format_number({0}, 2)", "states": _MAP}
DUCK = {"date": "strftime(l_shipdate, '%d-%m-%Y')", "commas": "format('{{:,.2f}}', CAST({0} AS DOUBLE))", "states": _CASE}


def layouts(dialect: dict) -> dict[str, str]:
    """The text of a line in each layout, as SQL over the invoices."""
    m = lambda c: dialect["commas"].format(c)
    cat = lambda *x: "concat(" + ", ' ', ".join(x) + ")"
    return {
        "image": cat("gstin", "name", "concat('INV-', okey)", "'R'", "inv_date", m("value"), m("taxable"), m("igst"), m("half"), m("half"), "pos", "concat(rate, '%')", "rc"),
        "register": cat("inv_date", "okey", "name", "gstin", m("taxable"), m("igst"), m("half"), m("half"), "'0.00'", m("value")),
        "wide": cat("CAST(ord AS STRING)", "name", "gstin", "CASE WHEN parity = 1 THEN concat('INV-', okey, 'R', inv_date) ELSE concat('INV-', okey, ' R ', inv_date) END", "CAST(value AS STRING)", "pos", "rc", "rate", "CAST(taxable AS STRING)", "CAST(igst AS STRING)", "CAST(half AS STRING)", "CAST(half AS STRING)", "'0.00 Y 11-Feb-24 Feb-24 Y N'", "CASE WHEN parity = 1 THEN 'E-Invoice' ELSE 'Manual' END"),
        "bill": cat("concat('1', lpad(okey, 11, '0'))", "inv_date", m("taxable"), m("igst"), m("half"), m("half"), m("value"), "pos", "CASE WHEN parity = 1 THEN 'Road' ELSE 'Rail' END", "CASE WHEN rc = 'Y' THEN 'Active' ELSE 'Delivered' END", "gstin"),
        "generic": cat("'Ref'", "inv_date", "CASE WHEN parity = 1 THEN gstin ELSE '-' END", m("taxable"), m("igst"), m("value")),
    }


_DOC = "CAST(floor(l_orderkey / 32) AS BIGINT)"


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices of the driver's tables. Their document is a column before they are numbered, so that Spark knows that they
    are dealt by it, and what goes on by document deals nothing again."""
    lineitem, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier"))
    sql = _base(**SPARK).replace(f"{_DOC} AS doc_id", "doc_id").replace(f"PARTITION BY {_DOC}", "PARTITION BY doc_id")
    return spark.sql(sql.replace("FROM lineitem JOIN supplier", "FROM {lineitem} JOIN {supplier}"), lineitem=lineitem.withColumn("doc_id", F.expr(_DOC)), supplier=supplier)


def lines(inv: DataFrame, layout: str) -> DataFrame:
    """(doc_id, page_no, ord, text) in one layout."""
    return settled(inv.select("doc_id", "page_no", "ord", F.expr(layouts(SPARK)[layout]).alias("text")), F.lit(True))


#: Documents in turn: statement lines, statement lines with their identifiers torn, bills, loose tables, two statement lines only.
_MIXED = """CASE doc_id % 5 WHEN 0 THEN {image} WHEN 1 THEN concat(substring({image}, 1, 7), ' ', substring({image}, 8))
            WHEN 2 THEN {bill} WHEN 3 THEN {generic} ELSE CASE WHEN ord <= 2 THEN {image} ELSE 'filler without figures' END END"""


def mixed(inv: DataFrame) -> DataFrame:
    return settled(inv.select("doc_id", "page_no", "ord", F.expr(_MIXED.format(**layouts(SPARK))).alias("text")), F.lit(True))


#: Documents whose lines were read badly while the boxes of their words were not: bills without numbers and identifiers
#: below a heading, and pages of which only fillers were left.
_LOST = """CASE doc_id % 5 WHEN 2 THEN CASE WHEN ord = 1 THEN 'E-Way Bill Consignor Consignee' ELSE substring({bill}, 14, length({bill}) - 29) END WHEN 4 THEN 'filler without figures' ELSE {mixed} END"""
_BOXED = "CASE doc_id % 5 WHEN 4 THEN {image} ELSE {mixed} END"


def boxed(inv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, the texts of the rows of their boxes)."""
    make = lambda t: settled(inv.select("doc_id", "page_no", "ord", F.expr(t.format(**layouts(SPARK), mixed=_MIXED.format(**layouts(SPARK)))).alias("text")), F.lit(True))
    return make(_LOST), make(_BOXED)


def sql_boxed() -> str:
    """A WITH clause for the oracle: inv, li and lb, as boxed() gives them."""
    text = lambda t: t.format(**layouts(DUCK), mixed=_MIXED.format(**layouts(DUCK)))
    return f"WITH inv AS ({_base(**DUCK)}), li AS (SELECT doc_id, page_no, ord, {text(_LOST)} AS text FROM inv), lb AS (SELECT doc_id, page_no, ord, {text(_BOXED)} AS text FROM inv)"


def sql(layout: str | None = None) -> str:
    """A WITH clause for the oracle: inv, and li (doc_id, page_no, ord, text) in a layout or mixed."""
    base = f"WITH inv AS ({_base(**DUCK)})"
    if layout is None:
        return base
    text = _MIXED.format(**layouts(DUCK)) if layout == "mixed" else layouts(DUCK)[layout]
    return f"{base}, li AS (SELECT doc_id, page_no, ord, {text} AS text FROM inv)"
