"""Registered queries, one for each operator, and the SQL that an oracle runs over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateledger.functions import constants as C
from slateledger.functions import scalars as S
from slateledger.operators import cascade as cascade_, evaluate, ocr, parse, records, report
from slateledger.plans import oracle as O
from slateledger.plans import imaging, plugged, render
from slateledger.sources import ingest, jobtable, sinks
from slateledger.streaming import jobs as jobs_
from slateledger.streaming import states as states_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def on_lines(name: str, layout: str, fn: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over rendered lines of one layout; sql goes after the WITH clause that renders them."""
    make = render.mixed if layout == "mixed" else lambda inv: render.lines(inv, layout)
    query(name, sql)(lambda spark, d: fn(make(render.invoices(spark, d))))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scalar(name: str, layout: str, cols: dict[str, tuple], sql_cols: dict[str, str]) -> None:
    """Columns computed from a line's text, by line."""
    on_lines(name, layout, lambda li: li.select("doc_id", "ord", *[c("text").alias(k) for k, c in cols.items()]), f"{render.sql(layout)} SELECT doc_id, ord, {', '.join(f'{v} AS {k}' for k, v in sql_cols.items())} FROM li")


# ------------------------------------------------------------------ parsers

on_lines("q_parse_itc", "register", parse.parse_register, O.register(render.sql("register")))
on_lines("q_parse_wide", "wide", parse.parse_wide, O.wide(render.sql("wide")))
on_lines("q_parse_line", "image", parse.parse_lines, O.line(render.sql("image")))
on_lines("q_parse_blocks", "image", lambda li: parse.parse_blocks(li).drop("ord"), O.line(render.sql("image")).replace("SELECT doc_id, CAST(ord AS BIGINT) AS ord,", "SELECT doc_id,"))
on_lines("q_parse_anchored", "image", parse.parse_anchored, O.anchored(render.sql("image")))
on_lines("q_parse_generic", "generic", parse.parse_generic, O.generic(render.sql("generic")))
on_lines("q_parse_ewb", "bill", parse.parse_bills, O.bill(render.sql("bill")))
on_lines("q_parse_reconstruct", "mixed", parse.parse_rebuilt, O.rebuilt(render.sql("mixed")))
on_lines("q_parse_colscan", "mixed", lambda li: parse.parse_columns(boxes(li)), O.column_rows(render.sql("mixed")))


def boxes(li: DataFrame) -> DataFrame:
    """Words of lines as boxes: 30 units a line, tilted by 5, ten a place."""
    words = li.select("doc_id", "ord", F.posexplode_outer(F.split("text", " ")).alias("at", "text")).where("text is not null")
    return words.select("doc_id", (F.col("ord") * 100 + F.col("at")).alias("pos"), "text", (F.col("at") * 10.0).alias("xc"), (F.col("ord") * 30.0 + F.col("at") % 5).alias("yc"))


on_lines("q_row_cluster", "image", lambda li: parse.row_clusters(boxes(li)), f"{render.sql('image')} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS ord, regexp_replace(text, ' +', ' ', 'g') AS text FROM li")


def faded(li: DataFrame) -> DataFrame:
    """Bill lines; of two documents in three the lines, in one of them from the third on, have lost bill number and identifier."""
    return li.withColumn("text", F.expr("CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 1 AND ord > 2) THEN substring(text, 14, length(text) - 29) ELSE text END"))


_READ = ["doc_id", "ord", "INVOICE_NO", "GSTIN", "TAXABLE_VALUE", "_source"]  # whole records are compared by q_parse_ewb
def _ewb_boxes(li: DataFrame) -> DataFrame:
    li = records.checkpointed(li)  # lines and boxes, both read more than once
    return parse.parse_bills(faded(li), boxes(li)).select(*_READ)


on_lines("q_ewb_boxes", "bill", _ewb_boxes, f"{render.sql('bill')}, by_line AS ({O.bill(O.INNER)}), by_box AS ({O.bill(O.INNER, alone=True)}) SELECT {', '.join(_READ)} FROM by_line WHERE doc_id % 3 = 2 UNION ALL SELECT {', '.join(_READ)} FROM by_box WHERE doc_id % 3 <> 2")


_SPLIT = {"GSTIN": "gstin", "TRADE_NAME": "name", "INVOICE_NO": "concat('INV-', okey)", "INVOICE_DATE": "inv_date", "INVOICE_VALUE": "CAST(value AS STRING)", "PLACE_OF_SUPPLY": "pos", "REVERSE_CHARGE": "rc", "TAX_RATE": "rate", "TAXABLE_VALUE": "CAST(taxable AS STRING)", "IGST": "CAST(igst AS STRING)", "CGST": "CAST(half AS STRING)", "SGST": "CAST(half AS STRING)", "CESS": "'0.00'", "GSTR1_STATUS": "'Y'", "GSTR1_FILING_DATE": "'11-Feb-24'", "GSTR1_PERIOD": "'Feb-24'", "GSTR3B_STATUS": "'Y'", "SOURCE": "CASE WHEN parity = 1 THEN 'Manual' ELSE 'IFF' END"}


@query("q_parse_split", f"{render.sql()} SELECT doc_id, ord, {', '.join(f'{_SPLIT.get(f) or O.lit(C.DEFAULTS[f])} AS {f}' for f in C.FIELDS)}, CAST(0.98 AS DOUBLE) AS _confidence, 'direct_pdf' AS _source FROM inv")
def q_parse_split(spark, d):
    """Three pages for each document: identifiers, amounts, registration. What is parsed is what was rendered."""
    return parse.parse_split(split_lines(render.invoices(spark, d))).withColumn("ord", F.col("ord").cast("long"))


def split_lines(inv: DataFrame) -> DataFrame:
    text = F.array(F.expr("concat(gstin, ' ', name, ' INV-', okey, ' R ', inv_date, ' ', value, ' ', pos, ' ', rc, ' ', rate)"), F.expr("concat(taxable, ' ', igst, ' ', half, ' ', half, ' 0.00 Y 11-Feb-24 Feb-24 Y')"), F.expr("concat('N N/A N/A ', CASE WHEN parity = 1 THEN 'Manual' ELSE 'IFF' END)"))
    head = F.array(F.lit("GSTIN of supplier Invoice Number"), F.lit("Taxable Value Central Tax"), F.lit("Amendment IRN Source"))
    own = inv.select("doc_id", "ord", F.posexplode(text).alias("page_no", "text"))
    heads = inv.select("doc_id").distinct().select("doc_id", F.lit(0).alias("ord"), F.posexplode(head).alias("page_no", "text"))
    both = own.unionByName(heads)
    return both.select("doc_id", "page_no", (F.col("page_no") * 1_000_000 + F.col("ord")).alias("ord"), "text")


# ------------------------------------------------------------------ scalars

_ID = {"strict": S.strict_id, "relaxed": lambda t: S.first(t, C.ID_RELAXED), "picked": S.any_id}
scalar("q_gstin_extract", "image", _ID, {"strict": O.first("text", C.ID), "relaxed": O.first("text", C.ID_RELAXED), "picked": f"CASE WHEN {O.first('text', C.ID)} <> '' THEN {O.first('text', C.ID)} ELSE {O.first('text', C.ID_RELAXED)} END"})
scalar("q_gstin_valid", "image", {"gstin": S.strict_id, "valid": lambda t: S.valid_id(S.strict_id(t))}, {"gstin": O.first("text", C.ID), "valid": O.valid_id(O.first("text", C.ID))})
scalar("q_gstin_valid_calib", "image", {"gstin": S.strict_id, "valid": lambda t: S.valid_id_calibration(S.strict_id(t))}, {"gstin": O.first("text", C.ID), "valid": f"(regexp_matches({O.first('text', C.ID)}, '^\\d{{2}}[A-Z]{{5}}\\d{{4}}[A-Z]\\dZ[A-Z0-9]$') AND coalesce(TRY_CAST(substring({O.first('text', C.ID)}, 1, 2) AS INT), 0) BETWEEN 1 AND 38)"})
_TORN = "translate(substring(text, 1, 15), 'ABEZ', '184Z')"
scalar("q_gstin_repair", "image", {"raw": lambda t: F.expr(_TORN), "repaired": lambda t: S.repair_id(F.expr(_TORN))}, {"raw": _TORN, "repaired": O.repair(_TORN)})
scalar("q_invoice_clean", "wide", {"raw": lambda t: S.first(t, C.INVOICE), "cleaned": lambda t: S.clean_invoice(S.first(t, C.INVOICE)), "inner_date": lambda t: S.invoice_date(S.first(t, C.INVOICE))}, {"raw": O.first("text", C.INVOICE), "cleaned": O.clean_invoice(O.first("text", C.INVOICE)), "inner_date": O.first(O.first("text", C.INVOICE), C.DATE_ANYWHERE)})
scalar("q_invoice_fallback", "register", {"token": S.invoice_token}, {"token": "coalesce([t FOR t IN regexp_split_to_array(text, '\\s+') IF regexp_full_match(t, '\\d{3,8}')][1], '')"})
scalar("q_amount_image", "image", {"amounts": lambda t: F.array_join(S.every(t, C.IMAGE_AMOUNT), "|")}, {"amounts": f"array_to_string({O.every('text', C.IMAGE_AMOUNT)}, '|')"})
scalar("q_valid_amounts", "image", {"amounts": lambda t: F.array_join(S.image_amounts(t), "|")}, {"amounts": f"array_to_string({O.image_amounts('text')}, '|')"})
scalar("q_amounts", "register", {"plain": lambda t: F.array_join(S.every(t, C.AMOUNT), "|"), "fixed": lambda t: F.array_join(S.every(t, C.ITC_AMOUNT), "|"), "fallback": lambda t: F.array_join(S.every(t, C.PLAIN_AMOUNT), "|"), "decimals": lambda t: F.array_join(S.every(F.regexp_replace(t, ",", ""), C.PLAIN_AMOUNT), "|")}, {"plain": f"array_to_string({O.every('text', C.AMOUNT)}, '|')", "fixed": f"array_to_string({O.every('text', C.ITC_AMOUNT)}, '|')", "fallback": r"array_to_string(regexp_extract_all(text, '\b([0-9]{1,3}(,[0-9]{2,3})+(\.[0-9]{1,2})?|[0-9]+\.[0-9]{1,2})\b', 1), '|')", "decimals": r"array_to_string(regexp_extract_all(replace(text, ',', ''), '\b[0-9]+\.[0-9]{1,2}\b'), '|')"})
scalar("q_first_real_amount", "wide", {"amount": S.first_real_amount}, {"amount": O.real_amount("text")})
_D = {"strict": C.DATE, "image": C.IMAGE_DATE, "month": C.MONTH_DATE, "period": C.PERIOD}
scalar("q_dates", "wide", {k: (lambda p: lambda t: S.first(t, p))(p) for k, p in _D.items()}, {k: O.first("text", p) for k, p in _D.items()})
_K = {"rate": C.RATE, "kind": C.TYPE, "source": C.SOURCE, "irn": C.IRN, "bill_no": C.BILL_NO}
scalar("q_codes", "wide", {k: (lambda p: lambda t: S.first(t, p))(p) for k, p in _K.items()}, {k: O.first("text", p) for k, p in _K.items()})
_REST = f"trim(substring(text, 16))"
scalar("q_trade_name", "image", {"name": lambda t: F.trim(F.substring(F.expr(_REST), F.lit(1), S.name_end(F.expr(_REST))))}, {"name": f"CASE WHEN regexp_matches({_REST}, {O.lit(C.NAME_END)}) THEN trim({O.first(_REST, '(?s)^(.*?)' + C.NAME_END)}) ELSE '' END"})
scalar("q_pos_substring", "image", {"place": S.place_contained}, {"place": O.place("text")})
scalar("q_state_lookup", "image", {"pdf": lambda t: S.state_name(F.substring(t, 1, 2), C.PDF_STATES), "image": lambda t: S.state_name(F.substring(t, 1, 2), C.IMAGE_STATES)}, {"pdf": O.states("substring(text, 1, 2)", C.PDF_STATES), "image": O.states("substring(text, 1, 2)", C.IMAGE_STATES)})


# Place names without their fifth letter that are still read as a place, worked out with Python's difflib.
_NEAR = {
    "to Jamm and Kashmir by road": "Jammu and Kashmir", "to Himahal Pradesh by road": "Himachal Pradesh", "to Punjb by road": "Punjab",
    "to Chanigarh by road": "Chandigarh", "to Uttaakhand by road": "Uttarakhand", "to Haryna by road": "Haryana", "to Delh by road": "Delhi",
    "to Rajathan by road": "Rajasthan", "to Utta Pradesh by road": "Uttar Pradesh", "to Biha by road": "Bihar", "to Sikkm by road": "Sikkim",
    "to Arunchal Pradesh by road": "Arunachal Pradesh", "to Nagaand by road": "Nagaland", "to Maniur by road": "Manipur",
    "to Mizoam by road": "Mizoram", "to Tripra by road": "Tripura", "to Meghlaya by road": "Meghalaya", "to Assa by road": "Assam",
    "to WestBengal by road": "West Bengal", "to Jharhand by road": "Jharkhand", "to Odisa by road": "Odisha",
    "to Chhatisgarh by road": "Chhattisgarh", "to Madha Pradesh by road": "Madhya Pradesh", "to Gujaat by road": "Gujarat",
    "to Mahaashtra by road": "Maharashtra", "to Andha Pradesh by road": "Andhra Pradesh", "to Karntaka by road": "Karnataka",
    "to Goa by road": "Goa", "to Laksadweep by road": "Lakshadweep", "to Keraa by road": "Kerala", "to Tami Nadu by road": "Tamil Nadu",
    "to Puduherry by road": "Puducherry", "to Andaan by road": "Andaman", "to Telagana by road": "Telangana", "to Ladah by road": "Ladakh",
}
_LESS = "concat('to ', substring(pos, 1, 4), substring(pos, 6), ' by road')"


@query("q_pos_fuzzy", f"{render.sql()}, near(text, place) AS (VALUES {', '.join(f'({O.lit(k)}, {O.lit(v)})' for k, v in _NEAR.items())}) SELECT doc_id, ord, pos, coalesce(place, '') AS place FROM (SELECT doc_id, ord, pos, {_LESS} AS text FROM inv) q LEFT JOIN near USING (text)")
def q_pos_fuzzy(spark, d):
    """Names with a letter lost, found again."""
    from slateledger.functions.fuzzy import placed

    return placed(render.invoices(spark, d).select("doc_id", "ord", "pos", F.expr(_LESS).alias("text")), "text", "place").drop("text")


_RECALC = "CASE WHEN t > 100 AND (v = 0 OR (v > 0 AND v * 100 < t)) THEN CAST(CAST(t AS DECIMAL(15,2)) AS STRING) ELSE CAST(v AS STRING) END"


@query("q_recalc_value", f"{render.sql()} SELECT doc_id, ord, {_RECALC} AS value FROM (SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN CAST(ord AS DECIMAL(15,2)) ELSE value END AS v, taxable + igst + half + half AS t FROM inv) q")
def q_recalc_value(spark, d):
    inv = render.invoices(spark, d).withColumn("v", F.expr("CASE WHEN ord % 3 = 0 THEN CAST(ord AS DECIMAL(15,2)) ELSE value END"))
    s = lambda c: F.col(c).cast("string")
    return inv.select("doc_id", "ord", S.recalculated(s("v"), s("taxable"), s("igst"), s("half"), s("half"), F.lit("")).alias("value"))


@query("q_normalisers", f"{render.sql('register')} SELECT doc_id, ord, coalesce(TRY_CAST(replace(regexp_extract(text, '([\\d,]+\\.\\d{{2}})$', 1), ',', '') AS DOUBLE), 0) AS amount, left(upper(regexp_replace(substring(text, 1, 30), '\\s+', '', 'g')), 15) AS id, replace(trim(replace(substring(text, 1, 11), '-', '/')), '/', '-') AS day FROM li")
def q_normalisers(spark, d):
    li = render.lines(render.invoices(spark, d), "register")
    return li.select("doc_id", "ord", S.norm_amount(S.first("text", r"([\d,]+\.\d{2})$")).alias("amount"), S.norm_id(F.substring("text", 1, 30)).alias("id"), S.norm_date(F.replace(F.substring("text", 1, 11), F.lit("-"), F.lit("/"))).alias("day"))


# ------------------------------------------------------------------ lines, pages, documents

_HEADED = "CASE ord % 6 WHEN 0 THEN 'Invoice Number Invoice Date Taxable Value' WHEN 1 THEN 'Page ' || CAST(ord AS STRING) WHEN 2 THEN 'Grand Total' ELSE text END"
on_lines("q_header_filter", "wide", lambda li: li.select("doc_id", "ord", F.expr(_HEADED).alias("text")).where(~S.header_line("text")), f"{render.sql('wide')}, h AS (SELECT doc_id, ord, {_HEADED} AS text FROM li) SELECT * FROM h WHERE NOT {O.header('text')}")
on_lines("q_ewb_header_filter", "bill", lambda li: li.select("doc_id", "ord", F.expr(_HEADED).alias("text")).where(~S.bill_header_line("text")), f"{render.sql('bill')}, h AS (SELECT doc_id, ord, {_HEADED} AS text FROM li) SELECT * FROM h WHERE NOT ({O.any_word('trim(lower(text))', C.EWB_HEADERS)} AND length(trim(text)) < 100)")
_TEXT = O.TEXTS
on_lines("q_doc_format", "mixed", cascade_.document_formats, f"{render.sql('mixed')}, {_TEXT} SELECT doc_id, {O.FORMAT} AS fmt FROM dt")
on_lines("q_blocks", "mixed", parse.blocks, f"{render.sql('mixed')}, {_TEXT} {O.block_texts()}")
on_lines("q_anchor_context", "image", lambda li: parse.contexts(li).select("doc_id", "ord", "context"), f"{render.sql('image')} SELECT doc_id, ord, string_agg(trim(text), ' ') OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS context FROM li")
on_lines("q_neighbour_context", "bill", lambda li: parse.contexts(li, 1, 1).select("doc_id", "ord", "context"), f"{render.sql('bill')} SELECT doc_id, ord, string_agg(trim(text), ' ') OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM li")
_TOKENS = "tk AS (SELECT doc_id * 100000 + ord AS doc_id, [t FOR t IN regexp_split_to_array(text, '\\s+') IF t <> ''] AS tokens FROM li)"
on_lines(
    "q_token_windows", "image",
    lambda li: parse.token_windows(li.select((F.col("doc_id") * 100000 + F.col("ord")).alias("doc_id"), S.tokens("text").alias("tokens"))),
    f"{render.sql('image')}, {_TOKENS}, w AS (SELECT doc_id, tokens, CAST(size AS INT) AS size, CAST(at_ AS INT) AS at_ FROM tk, unnest([2, 3, 4]) a(size), unnest(range(0, len(tokens) - size + 1)) b(at_)) SELECT * FROM (SELECT doc_id, size, at_ AS at, regexp_replace(upper(array_to_string(tokens[at_ + 1:at_ + size], '')), '[^A-Z0-9]', '', 'g') AS merged, array_to_string(tokens[greatest(0, at_ - 2) + 1:least(len(tokens), at_ + size + 8)], ' ') AS context FROM w) q WHERE length(merged) >= 15",
)
_PAGES = "pg AS (SELECT doc_id, CAST(page_no AS INT) AS page_no, string_agg(text, chr(10) ORDER BY ord) AS text FROM li GROUP BY doc_id, page_no)"


def pages(li: DataFrame) -> DataFrame:
    return li.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))


on_lines("q_explode_lines", "wide", lambda li: ingest.exploded_lines(pages(li).withColumn("text", F.concat("text", F.lit("\n")))), f"{render.sql('wide')} SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ord) - 1 AS INT) AS line_no, text FROM li")
on_lines("q_pdf_format", "register", lambda li: _pdf_format(li), f"{render.sql('register')}, {_PAGES}, m AS (SELECT doc_id, page_no, CASE WHEN doc_id % 3 = 0 AND page_no = 0 THEN 'purchase register ' WHEN doc_id % 3 = 1 AND page_no = 0 THEN 'invoice no and taxable value ' ELSE '' END || text AS text FROM pg), f AS (SELECT doc_id, string_agg(CASE WHEN page_no < 3 THEN lower(text) END, '' ORDER BY page_no) AS t, count(*) AS n FROM m GROUP BY doc_id) SELECT doc_id, n, CASE WHEN {O.any_word('t', C.ITC_MARKERS)} THEN 'ITC' WHEN ({O.any_word('t', C.GROUP_A_MARKERS)} AND {O.any_word('t', C.GROUP_B_MARKERS)}) OR n <= 2 THEN 'B' ELSE 'A' END AS fmt FROM f")


def _pdf_format(li: DataFrame) -> DataFrame:
    head = F.when((F.col("doc_id") % 3 == 0) & (F.col("page_no") == 0), "purchase register ").when((F.col("doc_id") % 3 == 1) & (F.col("page_no") == 0), "invoice no and taxable value ").otherwise("")
    marked = pages(li).withColumn("text", F.concat(head, "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("page_no") < 3, F.struct("page_no", "text")))), lambda x: x["text"]), "")
    return marked.groupBy("doc_id").agg(joined.alias("t"), F.count("*").alias("n")).select("doc_id", "n", S.statement_format("t", "n").alias("fmt"))


_MARKED = "CASE page_no WHEN 0 THEN 'GSTIN ' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'Central Tax ' ELSE '' END WHEN 2 THEN 'Amendment Central Tax ' ELSE '' END"
_GROUPS = f"""{render.sql('register')}, {_PAGES}, m AS (SELECT doc_id, page_no, lower({_MARKED} || text) AS t FROM pg),
k AS (SELECT doc_id, page_no, {O.any_word('t', C.GROUP_A_MARKERS)} AS a_, {O.any_word('t', C.GROUP_B_MARKERS)} AS b_, {O.any_word('t', C.GROUP_C_MARKERS)} AS c_ FROM m),
a AS (SELECT doc_id, count(*) AS n, min(CASE WHEN a_ THEN page_no END) AS a FROM k GROUP BY doc_id),
b AS (SELECT k.doc_id, min(page_no) AS b FROM k JOIN a USING (doc_id) WHERE b_ AND page_no > a GROUP BY k.doc_id),
c AS (SELECT k.doc_id, min(page_no) AS c FROM k JOIN b USING (doc_id) WHERE c_ AND page_no > b GROUP BY k.doc_id)
SELECT doc_id, n, coalesce(a, 0) AS a, least(n, coalesce(b, greatest(1, n // 3))) AS b, least(n, coalesce(c, greatest(2, 2 * n // 3))) AS c FROM a LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""
on_lines("q_page_groups", "register", lambda li: parse.page_groups(pages(li).withColumn("text", F.concat(F.expr(_MARKED), "text"))), _GROUPS)


_PIECE = "array_to_string([text[i + 1] FOR i IN range(length(text)) IF {}], '')"


@query("q_stream_order_text", f"{render.sql('image')}, p AS (SELECT doc_id, page_no, CAST(ord * 12 AS INT) AS y, {_PIECE.format('i % 5 < 2')} AS text FROM li UNION ALL SELECT doc_id, page_no, CAST(ord * 12 + 3 AS INT), {_PIECE.format('i % 5 >= 2')} FROM li) SELECT * FROM p WHERE text <> ''")
def q_stream_order_text(spark, d):
    """Characters of the lines, each up to four units off its line's height, so that three in five round to the next one."""
    li = render.lines(render.invoices(spark, d), "image")
    ch = F.transform(F.split("text", ""), lambda c, at: F.struct(c.alias("ch"), (F.col("ord") * 12.0 + at % 5).alias("top")))
    return ingest.stream_order_of(li.select("doc_id", "page_no", F.col("ord").alias("pos"), ch.alias("chars")))


_PATHS = "CASE doc_id % 4 WHEN 0 THEN concat('/in/GSTR2A_', CAST(doc_id + 1000 AS STRING), '.pdf') WHEN 1 THEN concat('/in/b_', CAST(doc_id + 1000 AS STRING), '.PDF') WHEN 2 THEN concat('/in/scan_', CAST(doc_id + 1000 AS STRING), '.jpg') ELSE concat('/in/', CAST(doc_id AS STRING), '.docx') END"


_PAGE = "substring(text, page_no * 150 + 1, CASE page_no WHEN 3 THEN length(text) ELSE 150 END)"


@query("q_classify_docs", f"WITH p AS (SELECT doc_id, page_no, length(trim({_PAGE})) AS n FROM documents, unnest(range(4)) t(page_no)), m AS (SELECT doc_id, avg(n) AS c FROM p WHERE page_no < 3 GROUP BY doc_id) SELECT doc_id, path, CASE WHEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) <> '.pdf' THEN 'image' WHEN coalesce(c, 0) >= 100 THEN 'digital_pdf' ELSE 'photo_pdf' END AS kind FROM (SELECT doc_id, {_PATHS} AS path FROM documents) q LEFT JOIN m USING (doc_id)")
def q_classify_docs(spark, d):
    """Documents of four pages, the fourth with all that is left."""
    docs = read(spark, d, "documents")
    own = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("page_no")).select("doc_id", "page_no", F.expr(_PAGE).alias("text"))
    return ingest.classified(own, docs.select("doc_id", F.expr(_PATHS).alias("path")))


@query("q_ingest_filter", f"SELECT doc_id, path, n_chars * 10000 AS length, CASE WHEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) NOT IN ({', '.join(map(O.lit, ingest.EXTENSIONS))}) THEN 'bad_extension' WHEN n_chars * 10000 > 104857600 THEN 'too_large' END AS reason FROM (SELECT doc_id, n_chars, {_PATHS} AS path FROM documents) q")
def q_ingest_filter(spark, d):
    return ingest.guarded(read(spark, d, "documents").select("doc_id", F.expr(_PATHS).alias("path"), (F.col("n_chars") * 10000).alias("length")))


@query("q_file_number", f"SELECT doc_id, regexp_extract(regexp_replace(path, '^.*/', ''), '_(\\d{{4}})', 1) AS file_num FROM (SELECT doc_id, {_PATHS} AS path FROM documents) q")
def q_file_number(spark, d):
    return read(spark, d, "documents").select("doc_id", ingest.file_number(F.expr(_PATHS)).alias("file_num"))


_UUID = "concat(CASE doc_id % 3 WHEN 0 THEN '/up/' WHEN 1 THEN 'C:/data/x.y/' ELSE '' END, CASE doc_id % 2 WHEN 0 THEN '9982A939-eca1-48dd-bce6-010bf8dee05d_' ELSE '' END, source, ' ', CAST(doc_id AS STRING), '#.v2', CASE doc_id % 5 WHEN 0 THEN '' ELSE '.pdf' END)"
_STEM = "regexp_replace(regexp_replace(regexp_replace(path, '^.*/', ''), '(.)\\.[^.]*$', '\\1'), '^9982A939-eca1-48dd-bce6-010bf8dee05d_', '')"


@query("q_display_name", f"SELECT doc_id, {_STEM} AS display, regexp_replace({_STEM}, '[^A-Za-z0-9_.-]', '_', 'g') AS clean FROM (SELECT *, {_UUID} AS path FROM documents) q")
def q_display_name(spark, d):
    return read(spark, d, "documents").select("doc_id", S.display_name(F.expr(_UUID)).alias("display"), S.sanitised(S.display_name(F.expr(_UUID))).alias("clean"))


# Pages with two tables each: cells with marks, entities and line ends; every third one leaves rows and cells open.
_OPEN = "CASE WHEN page_id % 3 = 0 THEN '' ELSE '</td>' END"
_HTML = f"concat(html, '<table class=\"a\"><tr><th> No </th><th>Ad<b>dress</b></th></tr><tr><td>', CAST(page_id AS STRING), {_OPEN}, '<td>', url, ' ', chr(10), ' &amp; more', {_OPEN}, CASE WHEN page_id % 3 = 0 THEN '' ELSE '</tr>' END, '</table><p>x</p><TABLE><TR><TD>', CAST(length(html) AS STRING), '</TD></TR><tr></tr></TABLE><table></table>')"


@query("q_html_cells", "SELECT page_id, '[[[\"No\",\"Address\"],[\"' || page_id || '\",\"' || url || ' & more\"]],[[\"' || length(html) || '\"],[]]]' AS tables FROM pages")
def q_html_cells(spark, d):
    return read(spark, d, "pages").select("page_id", F.to_json(ingest.html_tables(F.expr(_HTML))).alias("tables"))


_REPLY = "CASE doc_id % 4 WHEN 0 THEN concat('Sure: {\"a\": \"n', CAST(doc_id AS STRING), '\", \"c\": ', CAST(n_chars AS STRING), '} done') WHEN 1 THEN 'no reply' WHEN 2 THEN concat('{\"b\": \"', lang, '\"}') ELSE '{\"a\": broken' END"
_GOT = "regexp_extract(reply, '(?s)\\{.*\\}', 0)"


@query("q_llm_json_merge", f"SELECT doc_id, coalesce(CASE WHEN json_valid({_GOT}) THEN json_extract_string({_GOT}, '$.a') END, source) AS a, coalesce(CASE WHEN json_valid({_GOT}) THEN json_extract_string({_GOT}, '$.b') END, 'kept') AS b, CASE WHEN json_valid({_GOT}) THEN json_extract_string({_GOT}, '$.c') END AS c FROM (SELECT *, {_REPLY} AS reply FROM documents) q")
def q_llm_json_merge(spark, d):
    own = F.create_map(F.lit("a"), F.col("source"), F.lit("b"), F.lit("kept"))
    got = read(spark, d, "documents").select("doc_id", ingest.merged_reply(own, F.expr(_REPLY)).alias("m"))
    return got.select("doc_id", *[F.col("m")[k].alias(k) for k in "abc"])


# Headers for every field, in the order of their columns, and one for none; a later column of a field wins.
_HEADS = {
    "Supplier GSTIN ": "GSTIN", "Trade/Legal name": "TRADE_NAME", "Invoice No": "INVOICE_NO", " INVOICE DATE": "INVOICE_DATE", "Invoice Value": "INVOICE_VALUE", "Taxable amount": "TAXABLE_VALUE", "Integrated Tax": "IGST",
    "CGST": "CGST", "Central Tax": "CGST", "State/UT Tax": "SGST", "Cess": "CESS", "Return Period": "RETURN_PERIOD", "Place of Supply": "PLACE_OF_SUPPLY", "Tax Rate": "TAX_RATE", "Reverse Charge": "REVERSE_CHARGE", "Type of invoice": "INVOICE_TYPE",
    "Source": "SOURCE", "IRN": "IRN", "IRN date": "IRN_DATE", "Remarks": None, "Invoice No 2": "INVOICE_NO",
}
_CELL = lambda h: f"concat('{h.strip()[:3]}', CAST({list(_HEADS).index(h)} AS STRING), '-', CAST(doc_id AS STRING))"
_LAST = {f: _CELL(h) for h, f in _HEADS.items() if f}


@query("q_header_mapping", "SELECT doc_id, CAST(0 AS BIGINT) AS ord, " + ", ".join(f"{_LAST.get(f) or O.lit({**C.DEFAULTS}.get(f, ''))} AS {f}" for f in [*C.FIELDS, "RETURN_PERIOD"]) + " FROM documents WHERE doc_id % 3 <> 0")
def q_header_mapping(spark, d):
    """Rows of cells under 21 headers; every third document has no identifier, so no record."""
    from slateledger.operators.tables import table_records

    cells = F.array(*[F.when((F.col("doc_id") % 3 == 0) & F.lit(f == "GSTIN"), "").otherwise(F.expr(_CELL(h))) for h, f in _HEADS.items()])
    rows = F.array(F.array(*map(F.lit, _HEADS)), cells, F.array_repeat(F.lit(""), len(_HEADS)))
    return table_records(read(spark, d, "documents").select("doc_id", rows.alias("rows"))).drop("_confidence", "_source")


# ------------------------------------------------------------------ records and reports

_REC = {"GSTIN": "CASE WHEN ord % 17 = 0 THEN '' ELSE gstin END", "TRADE_NAME": "CASE WHEN ord % 9 = 0 THEN ' None ' ELSE concat(' ', name) END", "INVOICE_NO": "CASE WHEN ord % 17 = 0 THEN '' ELSE concat('INV-', substring(okey, 1, 4)) END", "INVOICE_DATE": "inv_date", "INVOICE_VALUE": "CASE WHEN ord % 10 = 0 THEN 'n.a.' WHEN ord % 11 = 0 THEN CAST(ord AS STRING) ELSE CAST(value AS STRING) END", "TAXABLE_VALUE": "CAST(taxable AS STRING)", "IGST": "CAST(igst AS STRING)", "CGST": "CAST(half AS STRING)", "SGST": "CAST(half AS STRING)", "CESS": "''", "TAX_RATE": "rate", "PLACE_OF_SUPPLY": "CASE WHEN ord % 4 = 0 THEN '' ELSE pos END", "SOURCE": "CASE prio % 3 WHEN 0 THEN 'E-Invoice' WHEN 1 THEN 'Manual' ELSE 'IFF' END"}
_RCOLS = ", ".join(f"{_REC.get(f, O.lit(C.DEFAULTS.get(f, '')))} AS {f}" for f in C.FIELDS)
_CONF = "CASE WHEN ord % 10 = 0 THEN 'bad' WHEN parity = 1 THEN '0.8' ELSE '0.95' END"
_RSQL = f"{render.sql()}, r AS (SELECT doc_id, ord, {_RCOLS}, {_CONF} AS _confidence FROM inv)"


def raw_records(spark, d) -> DataFrame:
    """Records with blanks, wrong numbers and repeats."""
    return render.invoices(spark, d).select("doc_id", "ord", *[F.expr(_REC.get(f, O.lit(C.DEFAULTS.get(f, "")))).alias(f) for f in C.FIELDS], F.expr(_CONF).alias("_confidence"))


def on_records(name: str, fn: Callable[[DataFrame], DataFrame], sql: str) -> None:
    query(name, f"{_RSQL} {sql}")(lambda spark, d: fn(raw_records(spark, d)))


_M = lambda f: f"TRY_CAST(replace({f}, ',', '') AS DECIMAL(15,2))"
_SUM = lambda f: f"coalesce(sum({_M(f)}), 0)"
_FLAT = lambda f: f"CASE WHEN lower(trim({f})) IN ('none', 'nan') THEN '' ELSE trim({f}) END"
_TOT = f"coalesce({_M('TAXABLE_VALUE')}, 0) + coalesce({_M('IGST')}, 0) + coalesce({_M('CGST')}, 0) + coalesce({_M('SGST')}, 0) + coalesce({_M('CESS')}, 0)"
_VAL = f"coalesce({_M('INVOICE_VALUE')}, 0)"
_NORM = f"SELECT * REPLACE (CASE WHEN {_TOT} > 100 AND ({_VAL} = 0 OR ({_VAL} > 0 AND {_VAL} * 100 < {_TOT})) THEN CAST(CAST({_TOT} AS DECIMAL(15,2)) AS STRING) ELSE INVOICE_VALUE END AS INVOICE_VALUE, CASE WHEN PLACE_OF_SUPPLY = '' THEN {O.states('substring(GSTIN, 1, 2)', C.PDF_STATES)} ELSE PLACE_OF_SUPPLY END AS PLACE_OF_SUPPLY) FROM r"
on_records("q_normalise_records", records.normalise, _NORM)
on_records("q_flatten_values", lambda r: r.select("doc_id", "ord", S.flat("TRADE_NAME").alias("name"), records.unwrap(F.array("SOURCE")).alias("source"), records.unwrap(F.array().cast("array<string>")).alias("none")), f"SELECT doc_id, ord, {_FLAT('TRADE_NAME')} AS name, SOURCE AS source, '' AS none FROM r")
on_records("q_export_rows", records.flatten, f"SELECT doc_id, ord, {', '.join(f'TRY_CAST({f} AS DOUBLE) AS {f}' if f in C.NUMERIC else f'{_FLAT(f)} AS {f}' for f in C.FIELDS)} FROM r")
on_records("q_totals", report.totals, "SELECT " + ", ".join(f"{_SUM(f)} AS {f}" for f in C.AMOUNTS) + " FROM r")
_SUMMARY = "SELECT count(*) AS records, count(DISTINCT GSTIN) AS suppliers, " + ", ".join(f"{_SUM(f)} AS {f.lower()}" for f in C.AMOUNTS) + f", round(avg(coalesce(TRY_CAST(_confidence AS DOUBLE), 0)) * 100, 6) AS confidence, {_SUM('IGST')} + {_SUM('CGST')} + {_SUM('SGST')} + {_SUM('CESS')} AS tax FROM r"
on_records("q_summary_totals", report.summary, _SUMMARY)
_RUPEES = lambda f: f"CASE WHEN {f} = 0 THEN '₹0.00' ELSE '₹' || format('{{:,.2f}}', CAST({f} AS DOUBLE)) END"
_SOURCES = "c AS (SELECT SOURCE, count(*) AS n, min(doc_id * 100000 + ord) AS f FROM r GROUP BY SOURCE)"
_SHOWN = {"records": "CAST(records AS STRING)", "suppliers": "CAST(suppliers AS STRING)", "sources": "(SELECT string_agg(SOURCE || ':' || CAST(n AS STRING), ', ' ORDER BY n DESC, f) FROM c)", "accuracy": "format('{:.1f}%', confidence)"}
on_records("q_summary_sheet", report.summary_sheet, f", {_SOURCES}, s AS ({_SUMMARY}) " + " UNION ALL ".join(f"SELECT {i} AS pos, {O.lit(m)} AS metric, {_SHOWN.get(c) or _RUPEES(c)} AS value, {O.lit(n)} AS note FROM s" for i, (m, c, n) in enumerate(report.SHEET)))
on_records("q_unique_suppliers", lambda r: r.agg(F.count_distinct(F.coalesce("GSTIN", F.lit(""))).alias("suppliers")), "SELECT count(DISTINCT coalesce(GSTIN, '')) AS suppliers FROM r")
on_records("q_source_counts", report.source_counts, f", {_SOURCES} SELECT SOURCE, n, (SELECT string_agg(SOURCE || ':' || CAST(n AS STRING), ', ' ORDER BY n DESC, f) FROM c) AS rendered FROM c")
on_records("q_avg_confidence", lambda r: r.agg(F.round(F.avg(F.coalesce(F.col("_confidence").try_cast("double"), F.lit(0.0))), 6).alias("confidence")), "SELECT round(avg(coalesce(TRY_CAST(_confidence AS DOUBLE), 0)), 6) AS confidence FROM r")
on_records("q_dedupe", lambda r: records.deduplicated(r).select("doc_id", "ord", "GSTIN", "INVOICE_NO"), "SELECT doc_id, ord, GSTIN, INVOICE_NO FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, GSTIN, INVOICE_NO ORDER BY ord) AS k FROM r) q WHERE k = 1 OR (GSTIN = '' AND INVOICE_NO = '')")
on_records("q_prefix_limits", lambda r: r.withColumn("k", F.row_number().over(parse.in_order())).where("k <= 10").select("doc_id", "ord", F.substring(F.concat_ws(" ", "GSTIN", "TRADE_NAME", "INVOICE_VALUE"), 1, 2000).alias("sample")), "SELECT doc_id, ord, left(concat_ws(' ', GSTIN, TRADE_NAME, INVOICE_VALUE), 2000) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM r) q WHERE k <= 10")
_CHANGED = f"CAST(CASE WHEN {_TOT} > 100 AND ({_VAL} = 0 OR ({_VAL} > 0 AND {_VAL} * 100 < {_TOT})) THEN CAST(CAST({_TOT} AS DECIMAL(15,2)) AS STRING) ELSE INVOICE_VALUE END <> INVOICE_VALUE AS INT) + CAST(PLACE_OF_SUPPLY = '' AND {O.states('substring(GSTIN, 1, 2)', C.PDF_STATES)} <> '' AS INT)"
on_records("q_correction_count", lambda r: report.changed(records.normalise(report.with_original(r), keep=("_original",)), ["doc_id", "ord"]), f"SELECT doc_id, ord, {_CHANGED} AS changed FROM r")


def on_found(name: str, fn: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    """A query over mixed documents and the records that the line strategy finds in them: some documents have none, some two."""

    def run(li: DataFrame) -> DataFrame:
        return fn(li.select("doc_id").distinct(), parse.parse_lines(li))

    on_lines(name, "mixed", run, f"{render.sql('mixed')}, found AS ({O.line(O.INNER)}), n AS (SELECT doc_id, count(f.ord) AS n, coalesce(avg(_confidence), 0) AS c FROM (SELECT DISTINCT doc_id FROM li) d LEFT JOIN found f USING (doc_id) GROUP BY doc_id) {sql}")


on_found("q_route_decision", report.routes, "SELECT doc_id, n, CASE WHEN n >= 3 THEN 'digital' ELSE 'image' END AS route FROM n")
on_found("q_doc_confidence", report.document_confidence, "SELECT doc_id, round(c, 6) AS confidence FROM n")


#: The document that a side's row belongs to: its own, its neighbour, the one after that. All rows enter every side,
#: and as documents have different numbers of lines, the sides have, too.
_OWNERS = ("doc_id", "doc_id + 1 - 2 * (doc_id % 2)", "CASE WHEN doc_id % 4 < 2 THEN doc_id + 2 ELSE doc_id - 2 END")
_PARTS = ((0, 9), (9, 18), (18, 24))


def _side(k: int) -> str:
    (lo, hi), owner = _PARTS[k], _OWNERS[k]
    return f"{'abc'[k]} AS (SELECT {owner} AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k, {', '.join(C.FIELDS[lo:hi])} FROM r)"


_ZIPPED = ", ".join([*C.FIELDS[:9], *[f"coalesce({f}, {O.lit(C.DEFAULTS.get(f, ''))}) AS {f}" for f in C.FIELDS[9:]]])


@query("q_zip_groups", f"{_RSQL}, {_side(0)}, {_side(1)}, {_side(2)} SELECT doc_id, k AS ord, {_ZIPPED} FROM a FULL JOIN b USING (doc_id, k) FULL JOIN c USING (doc_id, k)")
def q_zip_groups(spark, d):
    r = records.checkpointed(raw_records(spark, d))  # read by three sides, dealt and numbered once
    sides = [r.select(F.expr(owner).alias("doc_id"), "ord", *C.FIELDS[lo:hi]) for owner, (lo, hi) in zip(_OWNERS, _PARTS, strict=True)]
    return parse.zip_groups(*sides).select("doc_id", F.col("ord").cast("long").alias("ord"), *C.FIELDS)


on_lines("q_emergency_fallback", "image", lambda li: parse.emergency(parse.document_text(li)).select("doc_id", F.col("ord").cast("long").alias("ord"), "GSTIN", "INVOICE_NO", "INVOICE_DATE", "INVOICE_VALUE", "TAXABLE_VALUE"), f"{render.sql('image')}, {_TEXT}, e AS (SELECT doc_id, {O.every('text', chr(92) + 'b(' + chr(92) + 'd{2}[A-Z0-9]{13})' + chr(92) + 'b')} AS g, {O.every('text', C.DATE)} AS d, {O.every('text', r'\b(\d+\.\d{1,2}|\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?)\b')} AS a FROM dt) SELECT doc_id, i - 1 AS ord, g[i] AS GSTIN, 'UNKNOWN-' || CAST(i AS STRING) AS INVOICE_NO, coalesce(d[i], '') AS INVOICE_DATE, coalesce(replace(a[2 * i - 1], ',', ''), '') AS INVOICE_VALUE, coalesce(replace(a[2 * i], ',', ''), '') AS TAXABLE_VALUE FROM e, unnest(range(1, len(g) + 1)) t(i)")


on_lines("q_bill_fallback", "bill", lambda li: parse.emergency_with_bills(parse.document_text(li.select("doc_id", "ord", F.expr("CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[0-9]{2}[A-J]{5}[0-9]{4}F1Z5', 'lost') END").alias("text")))).select("doc_id", "ord", "GSTIN", "INVOICE_NO", "SOURCE", "_confidence"), f"{render.sql('bill')} SELECT doc_id, ord - 1 AS ord, CASE WHEN doc_id % 2 = 0 THEN {O.first('text', C.ID)} ELSE '' END AS GSTIN, CASE WHEN doc_id % 2 = 0 THEN 'UNKNOWN-' || CAST(ord AS STRING) ELSE {O.first('text', C.BILL_NO)} END AS INVOICE_NO, CASE WHEN doc_id % 2 = 0 THEN 'regex_fallback' ELSE 'eway_bill_fallback' END AS SOURCE, CAST(CASE WHEN doc_id % 2 = 0 THEN 0.3 ELSE 0.25 END AS DOUBLE) AS _confidence FROM li")


# ------------------------------------------------------------------ cascade

@query("q_cascade", O.cascade_records(render.sql("mixed")))
def q_cascade(spark, d):
    return cascade_.cascade(render.mixed(render.invoices(spark, d)))


_KEPT = ["doc_id", "ord", "strategy", "GSTIN", "INVOICE_NO", "INVOICE_VALUE", "TAXABLE_VALUE", "PLACE_OF_SUPPLY", "_source"]


@query("q_cascade_boxes", f"SELECT {', '.join(_KEPT)} FROM ({O.cascade_records(render.sql_boxed(), boxed=True)}) z")
def q_cascade_boxes(spark, d):
    """The cascade with recognised boxes: bills and columns are read from them where lines give too little."""
    lines, rows = render.boxed(render.invoices(spark, d))
    return cascade_.cascade(lines, boxes(rows)).select(*_KEPT)


@query("q_cascade_choice", f"{O.cascade(render.sql('mixed'))} SELECT doc_id, strategy FROM chosen")
def q_cascade_choice(spark, d):
    return cascade_.cascade(render.mixed(render.invoices(spark, d))).select("doc_id", "strategy").distinct()


# ------------------------------------------------------------------ evaluation

_TRUTH = "SELECT CAST(doc_id + 1000 AS STRING) AS file_num, doc_id, ord, gstin AS GSTIN, concat('INV-', okey) AS INVOICE_NO, inv_date AS INVOICE_DATE, CAST(value AS STRING) AS INVOICE_VALUE, CAST(taxable AS STRING) AS TAXABLE_VALUE, CAST(igst AS STRING) AS IGST, CAST(half AS STRING) AS CGST, CAST(half AS STRING) AS SGST FROM {inv}"
_PRED = "SELECT CAST(doc_id + 1000 AS STRING) AS file_num, doc_id, ord, fmt, CASE WHEN ord % 11 = 0 THEN replace(gstin, 'A', '4') ELSE gstin END AS GSTIN, CASE WHEN ord % 9 = 0 THEN '' ELSE concat(' inv-', okey) END AS INVOICE_NO, replace(inv_date, '-', '/') AS INVOICE_DATE, CAST(CAST(value * CASE WHEN ord % 13 = 0 THEN CAST(1.05 AS DECIMAL(4,3)) WHEN ord % 5 = 0 THEN CAST(1.005 AS DECIMAL(4,3)) ELSE CAST(1 AS DECIMAL(4,3)) END AS DECIMAL(15,2)) AS STRING) AS INVOICE_VALUE, CAST(taxable AS STRING) AS TAXABLE_VALUE, CAST(igst AS STRING) AS IGST, CAST(half AS STRING) AS CGST, CAST(half AS STRING) AS SGST FROM {inv} CROSS JOIN (SELECT 'jpg' AS fmt UNION ALL SELECT 'png' AS fmt) f WHERE ord % 7 <> 0 AND doc_id % 10 <> 9 AND ((fmt = 'jpg' AND doc_id % 3 <> 0) OR (fmt = 'png' AND doc_id % 2 = 0))"


def truth_and_predictions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Truth, and predictions with rows lost, characters and amounts changed, in one or both formats."""
    inv = render.invoices(spark, d)
    return spark.sql(_TRUTH, inv=inv), spark.sql(_PRED, inv=inv)


_NG = lambda c: f"left(upper(regexp_replace(coalesce({c}, ''), '\\s+', '', 'g')), 15)"
_ESQL = f"""{render.sql()}, gt AS ({_TRUTH.format(inv='inv')}), p0 AS ({_PRED.format(inv='inv')}),
pr AS (SELECT p0.* FROM p0 JOIN (SELECT file_num, max(fmt) AS fmt FROM p0 GROUP BY file_num) m USING (file_num, fmt)),
t1 AS (SELECT * FROM (SELECT *, {_NG('GSTIN')} AS id, row_number() OVER (PARTITION BY file_num, {_NG('GSTIN')} ORDER BY ord DESC) AS k FROM gt) q WHERE k = 1 AND length(id) = 15),
pair AS (SELECT p.file_num, p.ord, p.fmt, {', '.join(f't.{f} AS t_{f}, p.{f} AS p_{f}' for f in S.MATCHED)} FROM pr p JOIN t1 t ON p.file_num = t.file_num AND {_NG('p.GSTIN')} = t.id)"""


def _cell(f: str) -> str:
    n = {S.norm_id: _NG, S.norm_invoice: lambda c: f"upper(trim({c}))", S.norm_date: lambda c: f"replace(trim({c}), '/', '-')", S.norm_amount: lambda c: f"coalesce(TRY_CAST({c} AS DOUBLE), 0)"}[S.MATCHED[f]]
    t, p = n(f"t_{f}"), n(f"p_{f}")
    if S.MATCHED[f] is S.norm_amount:
        m = f"CASE WHEN {t} = 0 AND {p} = 0 THEN TRUE WHEN {t} = 0 THEN FALSE ELSE abs({t} - {p}) / greatest(abs({t}), 1e-6) < 0.01 END"
    else:
        m = f"({t} = {p} AND {t} <> '')"
    return f"SELECT file_num, ord, '{f}' AS field, t_{f} AS truth, p_{f} AS predicted, {m} AS match FROM pair"


_CELLS = f"{_ESQL}, cells AS ({' UNION ALL '.join(map(_cell, S.MATCHED))})"


def on_pairs(name: str, fn: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    def run(spark, d):
        truth, predicted = truth_and_predictions(spark, d)
        return fn(truth, evaluate.latest_predictions(predicted))

    query(name, sql)(run)


on_pairs("q_field_match", lambda t, p: evaluate.matches(t, p, ["file_num"]), f"{_CELLS} SELECT * FROM cells")
on_pairs("q_match_join", lambda t, p: evaluate.matches(t, p, ["file_num"]).where("field = 'GSTIN'").select("file_num", "ord", "truth"), f"{_CELLS} SELECT file_num, ord, truth FROM cells WHERE field = 'GSTIN'")
on_pairs("q_file_join", lambda t, p: t.groupBy("file_num").agg(F.count("*").alias("truths")).join(p.groupBy("file_num", "fmt").agg(F.count("*").alias("predictions")), "file_num"), f"{_ESQL} SELECT file_num, fmt, truths, predictions FROM (SELECT file_num, count(*) AS truths FROM gt GROUP BY file_num) a JOIN (SELECT file_num, fmt, count(*) AS predictions FROM pr GROUP BY file_num, fmt) b USING (file_num)")
on_pairs("q_field_accuracy", lambda t, p: evaluate.field_accuracy(evaluate.matches(t, p, ["file_num"])), f"{_CELLS} SELECT field, CAST(sum(CAST(match AS INT)) AS BIGINT) AS correct, count(*) AS total, round(sum(CAST(match AS INT)) / count(*), 4) AS accuracy FROM cells GROUP BY field")
_RATES = "rates AS (SELECT file_num, gt_count, coalesce(matched, 0) AS matched FROM (SELECT file_num, count(*) AS gt_count FROM gt GROUP BY file_num) a LEFT JOIN (SELECT file_num, count(*) AS matched FROM pair GROUP BY file_num) b USING (file_num))"
on_pairs("q_detection_rate", lambda t, p: evaluate.detection(t, p, ["file_num"]), f"{_ESQL}, {_RATES} SELECT file_num, gt_count, matched, round(matched / greatest(gt_count, 1), 4) AS rate FROM rates")
on_pairs("q_accuracy_rollup", lambda t, p: evaluate.accuracy_by_format(evaluate.detection(t, p, ["file_num"]).join(p.select("file_num", "fmt").distinct(), "file_num")), f"{_ESQL}, {_RATES}, x AS (SELECT rates.*, fmt FROM rates JOIN (SELECT DISTINCT file_num, fmt FROM pr) f USING (file_num)) SELECT coalesce(fmt, 'overall') AS fmt, CAST(sum(matched) AS BIGINT) AS correct, CAST(sum(gt_count) AS BIGINT) AS total, round(sum(matched) / sum(gt_count), 4) AS rate FROM x GROUP BY ROLLUP (fmt)")
_KINDS = f"ti AS (SELECT DISTINCT file_num, {_NG('GSTIN')} AS id FROM gt), pi AS (SELECT DISTINCT file_num, {_NG('GSTIN')} AS id FROM pr), kinds AS (SELECT pi.*, 'tp' AS kind FROM pi SEMI JOIN ti USING (file_num, id) UNION ALL SELECT pi.*, 'fp' FROM pi ANTI JOIN ti USING (file_num, id) UNION ALL SELECT ti.*, 'fn' FROM ti ANTI JOIN pi USING (file_num, id))"
on_pairs("q_gstin_semi", lambda t, p: evaluate.overlap(t, p, ["file_num"]).where("kind = 'tp'").select("file_num", "id"), f"{_ESQL}, {_KINDS} SELECT file_num, id FROM kinds WHERE kind = 'tp'")
on_pairs("q_gstin_anti", lambda t, p: evaluate.overlap(t, p, ["file_num"]).where("kind <> 'tp'"), f"{_ESQL}, {_KINDS} SELECT file_num, id, kind FROM kinds WHERE kind <> 'tp'")
on_pairs("q_prf1", lambda t, p: evaluate.precision_recall(evaluate.overlap(t, p, ["file_num"])), f"{_ESQL}, {_KINDS}, n AS (SELECT count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn FROM kinds), r AS (SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM n) SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-6) AS f1 FROM r")
on_pairs("q_field_coverage", lambda t, p: evaluate.coverage(p), f"{_ESQL}, c AS ({' UNION ALL '.join(f'''SELECT '{f}' AS field, CAST(trim({f}) <> '' AS INT) AS filled FROM pr''' for f in S.MATCHED)}) SELECT field, CAST(sum(filled) AS BIGINT) AS filled, count(*) AS total, round(sum(filled) / count(*), 4) AS share FROM c GROUP BY field")
_CAL = f"(regexp_matches(upper(trim(GSTIN)), '^\\d{{2}}[A-Z]{{5}}\\d{{4}}[A-Z]\\dZ[A-Z0-9]$') AND coalesce(TRY_CAST(substring(upper(trim(GSTIN)), 1, 2) AS INT), 0) BETWEEN 1 AND 38)"
on_pairs("q_self_consistency", lambda t, p: evaluate.self_consistency(t.select("doc_id").distinct().withColumn("confidence", (F.col("doc_id") % 100).cast("double")), p), f"{_ESQL}, i AS (SELECT DISTINCT doc_id, CAST(doc_id % 100 AS DOUBLE) AS confidence FROM gt), q AS (SELECT doc_id, count(*) AS n, count(*) FILTER (trim(GSTIN) <> '') AS ids, count(*) FILTER {_CAL.replace('(regexp', '(WHERE regexp', 1)} AS valid FROM pr GROUP BY doc_id), a AS (SELECT count(*) AS images, count(n) AS with_records, CAST(coalesce(sum(n), 0) AS BIGINT) AS records, CAST(coalesce(sum(ids), 0) AS BIGINT) AS ids, CAST(coalesce(sum(valid), 0) AS BIGINT) AS valid, avg(confidence) AS c FROM i LEFT JOIN q USING (doc_id)) SELECT images, with_records, records, ids, valid, with_records / greatest(images, 1) AS extraction_rate, valid / greatest(ids, 1) AS id_validity, records / greatest(with_records, 1) AS records_per_image, c / 100 AS mean_confidence FROM a")


def _formats(name: str, fn: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    query(name, f"{_ESQL} {sql}")(lambda spark, d: fn(*truth_and_predictions(spark, d)))


_formats("q_format_exists", evaluate.available_format, "SELECT file_num, CASE WHEN bool_or(fmt = 'jpg') THEN 'jpg' ELSE 'png' END AS fmt FROM p0 GROUP BY file_num")
_formats("q_union_formats", lambda t, p: p.where("fmt = 'jpg'").select("file_num", "fmt", "ord", "GSTIN").unionByName(p.where("fmt = 'png'").select("fmt", "file_num", "GSTIN", "ord")), "SELECT file_num, fmt, ord, GSTIN FROM p0")
_formats("q_per_format", lambda t, p: p.groupBy("fmt").agg(F.count_distinct("file_num").alias("with_records"), F.count("*").alias("records")), "SELECT fmt, count(DISTINCT file_num) AS with_records, count(*) AS records FROM p0 GROUP BY fmt")


def _setops(t: DataFrame, p: DataFrame) -> DataFrame:
    jpg, png = (p.where(F.col("fmt") == f).select("file_num").distinct() for f in ("jpg", "png"))
    both = {"union": jpg.union(png).distinct(), "both": jpg.intersect(png), "jpg_only": jpg.exceptAll(png).distinct(), "png_only": png.subtract(jpg)}
    out = None
    for k, df in both.items():
        one = df.select(F.lit(k).alias("kind"), "file_num")
        out = one if out is None else out.unionByName(one)
    return out


_formats("q_filenum_setops", _setops, ", j AS (SELECT DISTINCT file_num FROM p0 WHERE fmt = 'jpg'), g AS (SELECT DISTINCT file_num FROM p0 WHERE fmt = 'png') SELECT 'union' AS kind, file_num FROM (SELECT * FROM j UNION SELECT * FROM g) u UNION ALL SELECT 'both', file_num FROM (SELECT * FROM j INTERSECT SELECT * FROM g) i UNION ALL SELECT 'jpg_only', file_num FROM (SELECT * FROM j EXCEPT SELECT * FROM g) a UNION ALL SELECT 'png_only', file_num FROM (SELECT * FROM g EXCEPT SELECT * FROM j) b")


@query("q_training_entries", f"{_RSQL} SELECT concat('job-', doc_id) AS job_id, concat('f', doc_id, '.pdf') AS source_file, ord, GSTIN, INVOICE_VALUE, count(*) OVER (PARTITION BY doc_id) AS record_count, 2 AS texts FROM r")
def q_training_entries(spark, d):
    """Training entries written as JSON, read again, and their records."""
    r, to = raw_records(spark, d), records.own_folder(spark, "entries")
    jobs = r.select("doc_id").distinct().select("doc_id", F.expr("concat('job-', doc_id)").alias("job_id"), F.expr("concat('f', doc_id, '.pdf')").alias("source_file"), F.lit("2024-01-01").alias("timestamp"), F.array(F.lit("a"), F.lit("b")).alias("ocr_text"))
    sinks.write_json(sinks.training_entries(r, jobs), to)
    got = ingest.training_entries(spark, to, multi_line=False).select("job_id", "source_file", "record_count", F.size("ocr_text").alias("texts"), F.posexplode("records").alias("at", "m"))
    return got.select("job_id", "source_file", (F.col("at") + 1).cast("long").alias("ord"), F.col("m")["GSTIN"].alias("GSTIN"), F.col("m")["INVOICE_VALUE"].alias("INVOICE_VALUE"), F.col("record_count").cast("long").alias("record_count"), "texts")


@query("q_correction_entries", f"{_RSQL}, n AS ({_NORM}), x AS (SELECT r.doc_id, r.ord, r.INVOICE_VALUE AS v, n.INVOICE_VALUE AS nv, r.PLACE_OF_SUPPLY AS p, n.PLACE_OF_SUPPLY AS np FROM r JOIN n ON r.doc_id = n.doc_id AND r.ord = n.ord) SELECT concat(doc_id, '-', ord) AS job_id, CASE WHEN nv <> v THEN nv END AS value, CASE WHEN np <> p THEN np END AS place, CAST(nv <> v AS INT) + CAST(np <> p AS INT) AS fields, v AS was FROM x")
def q_correction_entries(spark, d):
    """Corrections written as JSON and read again."""
    r, to = report.with_original(raw_records(spark, d)), records.own_folder(spark, "entries")
    done = records.normalise(r, keep=("_original",)).withColumn("job_id", F.expr("concat(doc_id, '-', ord)"))
    sinks.write_json(sinks.corrected_entries(done, "2024-01-01"), to)
    got = spark.read.schema("job_id string, corrections map<string,string>, original_data map<string,string>").json(to)
    return got.select("job_id", F.col("corrections")["INVOICE_VALUE"].alias("value"), F.col("corrections")["PLACE_OF_SUPPLY"].alias("place"), F.size("corrections").alias("fields"), F.col("original_data")["INVOICE_VALUE"].alias("was"))


_REPORT = "per_format map<string,struct<correct:long,total:long,rate:double>>, per_field map<string,struct<correct:long,total:long,accuracy:double>>"


def _calibration(t: DataFrame, p: DataFrame) -> DataFrame:
    """The report's JSON, read again."""
    by_format = evaluate.accuracy_by_format(evaluate.detection(t, p, ["file_num"]).join(p.select("file_num", "fmt").distinct(), "file_num"))
    got = sinks.calibration_report(by_format, evaluate.field_accuracy(evaluate.matches(t, p, ["file_num"]))).select(F.from_json("report", _REPORT).alias("r"))
    one = lambda m, share: got.select(F.explode(f"r.{m}").alias("key", "v")).select(F.lit(m).alias("part"), "key", "v.correct", "v.total", F.col(f"v.{share}").alias("share"))
    return one("per_format", "rate").unionByName(one("per_field", "accuracy"))


on_pairs("q_calibration_report", _calibration, f"{_CELLS}, {_RATES}, x AS (SELECT rates.*, fmt FROM rates JOIN (SELECT DISTINCT file_num, fmt FROM pr) f USING (file_num)) SELECT 'per_format' AS part, coalesce(fmt, 'overall') AS key, CAST(sum(matched) AS BIGINT) AS correct, CAST(sum(gt_count) AS BIGINT) AS total, round(sum(matched) / sum(gt_count), 4) AS share FROM x GROUP BY ROLLUP (fmt) UNION ALL SELECT 'per_field', field, CAST(sum(CAST(match AS INT)) AS BIGINT), count(*), round(sum(CAST(match AS INT)) / count(*), 4) FROM cells GROUP BY field")

_STATUS = "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'complete' ELSE 'failed' END"
_LATEST = "list_position(['queued', 'processing', 'complete', 'failed'], status)"


@query("q_job_states", f"SELECT job_id, ts, status, percent, message FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY done DESC, CASE WHEN done THEN ts END, CASE WHEN done THEN {_LATEST} END, CASE WHEN done THEN percent END, CASE WHEN done THEN message END, ts DESC, {_LATEST} DESC, percent DESC, message DESC) AS k FROM (SELECT *, status IN ('complete', 'failed') AS done FROM (SELECT user_id AS job_id, ts, {_STATUS} AS status, CAST(floor(value) AS INT) AS percent, CAST(event_id AS STRING) AS message FROM events) e) f) q WHERE k = 1")
def q_job_states(spark, d):
    """Every job's state by the stateful operator, where a final state stays."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", states_.STORE)
    return states_.job_states(read(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", F.expr(_STATUS).alias("status"), F.expr("CAST(floor(value) AS INT)").alias("percent"), F.col("event_id").cast("string").alias("message")))


@query("q_job_table", "SELECT o_orderkey AS job_id, concat('f', CAST(o_orderkey AS STRING), '.pdf') AS file, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'processing' ELSE 'queued' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'service error' END AS error, CAST(1 + CAST(o_orderkey % 2 = 0 AS INT) + CAST(o_orderkey % 3 = 0 AS INT) AS BIGINT) AS revision FROM orders")
def q_job_table(spark, d):
    """Jobs created, started and failed in three writes to a table of snapshots."""
    jobs, table = read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id")), jobtable.JobTable(spark, records.own_folder(spark, "jobs"))
    table.merge(jobs.select("job_id", F.expr("concat('f', CAST(job_id AS STRING), '.pdf')").alias("file"), F.lit("queued").alias("status")))
    table.merge(jobs.where("job_id % 2 = 0").select("job_id", F.lit("processing").alias("status"), F.lit(None).cast("string").alias("error")))
    table.merge(table.read()[1].where("job_id % 3 = 0").select("job_id", F.lit("failed").alias("status"), F.lit("service error").alias("error"), "revision"))
    return table.read()[1].select("job_id", "file", "status", "error", "revision")


@query("q_job_status", f"SELECT job_id, ts, status, percent, message FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, {_LATEST} DESC, percent DESC, message DESC) AS k FROM (SELECT user_id AS job_id, ts, {_STATUS} AS status, CAST(floor(value) AS INT) AS percent, CAST(event_id AS STRING) AS message FROM events) e) q WHERE k = 1")
def q_job_status(spark, d):
    return jobs_.latest(read(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", F.expr(_STATUS).alias("status"), F.expr("CAST(floor(value) AS INT)").alias("percent"), F.col("event_id").cast("string").alias("message")))


_PLACED = "SELECT user_id AS batch, event_id AS {}, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = '{}'"


@query("q_job_pairs", f"SELECT batch, local_id, service_id FROM ({_PLACED.format('local_id', 'click')}) a LEFT JOIN ({_PLACED.format('service_id', 'view')}) b USING (batch, k)")
def q_job_pairs(spark, d):
    """Local jobs and the service's, both in order of arrival."""
    e = read(spark, d, "events")
    side = lambda kind, name: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("batch"), F.col("event_id").alias(name), F.struct("ts", "event_id").alias("at"))
    return jobs_.paired(side("click", "local_id"), side("view", "service_id"), "batch", ["at"]).drop("at")


@query("q_best_epoch", "WITH r AS (SELECT CAST(user_id AS INT) AS epoch, round(least(count(*) / 80.0, 1), 4) AS rate FROM events GROUP BY user_id) SELECT epoch, CAST(rate AS DOUBLE) AS rate FROM r WHERE epoch <= coalesce((SELECT min(epoch) FROM r WHERE rate > 0.95), 2147483647) ORDER BY rate DESC, epoch LIMIT 1")
def q_best_epoch(spark, d):
    rates = read(spark, d, "events").groupBy(F.col("user_id").cast("int").alias("epoch")).agg(F.round(F.least(F.count("*") / 80.0, F.lit(1.0)), 4).alias("rate"))
    return evaluate.best_epoch(rates)


@query("q_dataset_stats", "SELECT raw, annotated, raw + annotated AS total, (raw // 5 + 1) * 5 AS next_trigger, (raw // 5 + 1) * 5 - raw AS remaining FROM (SELECT count(*) FILTER (event_type = 'click') AS raw, count(*) FILTER (event_type = 'view') AS annotated FROM events) q")
def q_dataset_stats(spark, d):
    n = read(spark, d, "events").agg(F.count_if(F.col("event_type") == "click").alias("raw"), F.count_if(F.col("event_type") == "view").alias("annotated"))
    nxt = (F.floor(F.col("raw") / 5) + 1) * 5
    return n.select("raw", "annotated", (F.col("raw") + F.col("annotated")).alias("total"), nxt.alias("next_trigger"), (nxt - F.col("raw")).alias("remaining"))


@query("q_train_triggers", "SELECT event_id, k FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) q WHERE k % 5 = 0")
def q_train_triggers(spark, d):
    from pyspark.sql import Window

    e = read(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.where("k % 5 = 0").select("event_id", "k")


@query("q_recent_jobs", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def q_recent_jobs(spark, d):
    return read(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(100)


# ------------------------------------------------------------------ recognition results


@query("q_best_ocr", "SELECT page, variant_ord, engine_ord, event_id FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY confidence * sqrt(greatest(line_count, 1)) DESC, variant_ord, engine_ord, event_id) AS k FROM (SELECT user_id AS page, event_id % 4 AS variant_ord, event_type AS engine_ord, event_id, value / 500 AS confidence, CAST(event_id % 30 AS INT) AS line_count FROM events) e) q WHERE k = 1")
def q_best_ocr(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("page"), (F.col("event_id") % 4).alias("variant_ord"), F.struct("event_type", "event_id").alias("engine_ord"), "event_id", (F.col("value") / 500).alias("confidence"), (F.col("event_id") % 30).cast("int").alias("line_count"))
    return ocr.best_results(e, ["page"]).select("page", "variant_ord", F.col("engine_ord.event_type").alias("engine_ord"), "event_id")


_WORDS = "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {t}) AS pos, CASE WHEN l_linenumber = 6 THEN ' ' ELSE concat('w', CAST(l_partkey AS STRING)) END AS text, CAST(l_quantity * 2 - 4 AS INT) AS conf, CAST(floor(l_linenumber / 3) AS INT) AS line_num, CAST(l_linenumber * 40 AS INT) AS left, CAST(l_suppkey % 9 AS INT) AS top, 30 AS width, 10 AS height FROM {src}"
_WSQL = f"WITH w AS ({_WORDS.format(t=render.TIES, src='lineitem').replace(' AS left', ' AS l').replace(' AS top', ' AS tp')}), u AS (SELECT *, CASE WHEN line_num IS DISTINCT FROM lag(line_num) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS n FROM w WHERE trim(text) <> '' AND conf >= 0), g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS line FROM u), ln AS (SELECT doc_id, CAST(line AS BIGINT) AS line, string_agg(trim(text), ' ' ORDER BY pos) AS text, avg(conf) AS conf, arg_min(l, pos) AS x0, arg_min(tp, pos) AS y0, max(l + width) AS x1, max(tp + height) AS y1 FROM g GROUP BY doc_id, line)"


def _words(spark, d) -> DataFrame:
    return spark.sql(_WORDS.format(t=render.TIES, src="{lineitem}").replace(" AS left", " AS `left`"), lineitem=read(spark, d, "lineitem"))


query("q_word_lines", f"{_WSQL} SELECT * FROM ln")(lambda spark, d: ocr.word_lines(_words(spark, d)))
query("q_page_stats", f"{_WSQL} SELECT doc_id, round(avg(conf) / 100, 6) AS confidence, count(*) AS lines FROM ln GROUP BY doc_id")(lambda spark, d: ocr.page_stats(ocr.word_lines(_words(spark, d))))


@query("q_variant_names", "SELECT event_id, CASE WHEN value / 500 >= 0.75 THEN 'colour clahe original' WHEN value / 500 >= 0.45 THEN 'colour binary clahe table original' ELSE 'colour binary denoise clahe shadow_binary table ocr_binary original' END AS names FROM events")
def q_variant_names(spark, d):
    return read(spark, d, "events").select("event_id", F.array_join(S.variant_names(F.col("value") / 500), " ").alias("names"))


@query("q_variant_plan", "SELECT event_id, CASE WHEN value / 500 >= 0.75 THEN 2 WHEN value / 500 >= 0.45 THEN 4 ELSE 7 END AS variants FROM events")
def q_variant_plan(spark, d):
    return read(spark, d, "events").select("event_id", S.variant_count(F.col("value") / 500).alias("variants"))


_SIZES = "CAST(l_partkey * 37 % 9000 + 400 AS INT) AS w, CAST(l_suppkey * 91 % 14000 + 300 AS INT) AS h, CAST(l_linenumber + l_orderkey % 3 AS INT) AS mark"
_FIT = "w > 6000 OR h > 9000"


@query("q_page_sizes", f"WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN mark BETWEEN 5 AND 8 THEN h ELSE w END AS w, CASE WHEN mark BETWEEN 5 AND 8 THEN w ELSE h END AS h FROM (SELECT *, {_SIZES} FROM lineitem) x), b AS (SELECT *, least(6000.0::DOUBLE / w, 9000.0::DOUBLE / h) AS s FROM a), c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {_FIT} THEN CAST(trunc(w * s) AS INT) ELSE w END AS w, CASE WHEN {_FIT} THEN CAST(trunc(h * s) AS INT) ELSE h END AS h FROM b) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN w < 3000 THEN CAST(trunc(w * least(3000.0::DOUBLE / w, 4)) AS INT) ELSE w END AS w, CASE WHEN w < 3000 THEN CAST(trunc(h * least(3000.0::DOUBLE / w, 4)) AS INT) ELSE h END AS h FROM c")
def q_page_sizes(spark, d):
    """Sizes of pictures after their orientation mark, brought to the sizes that are read."""
    own = read(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", *_SIZES.split(", C")[:1], *["C" + x for x in _SIZES.split(", C")[1:]])
    up = own.withColumn("u", S.upright_size(F.col("w"), F.col("h"), F.col("mark"))).withColumn("p", S.page_size(F.col("u.w"), F.col("u.h")))
    return up.select("l_orderkey", "l_linenumber", "l_partkey", "p.w", "p.h")


@query("q_quality_score", "SELECT l_orderkey, l_linenumber, l_partkey, round(least(least(l_quantity * 20 / 500, 1.0) * 0.35 + least(l_quantity * 2 / 60, 1.0) * 0.30 + greatest(0.0, 1 - abs(l_quantity * 8 - 185) / 185) * 0.20 + greatest(0.0, 1 - l_quantity / 20) * 0.15, 1.0), 3) AS quality FROM lineitem")
def q_quality_score(spark, d):
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.quality_score(q * 20, q * 2, q * 8, q).alias("quality"))


_ANGLES = "l_discount * 100 - l_tax * 50 - 3"


@query("q_deskew", f"WITH a AS (SELECT l_orderkey, list_sort(list({_ANGLES}) FILTER (abs({_ANGLES}) <= 5)) AS v FROM lineitem GROUP BY l_orderkey), m AS (SELECT l_orderkey, len(v) AS n, (v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2 AS mid FROM a) SELECT l_orderkey, round(CASE WHEN n >= 3 AND abs(mid) >= 0.3 THEN mid ELSE 0 END, 9) AS angle FROM m")
def q_deskew(spark, d):
    """The angle of each order's lines."""
    own = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.expr(_ANGLES)).alias("angles"))
    return own.select("l_orderkey", F.round(S.deskew_angle("angles"), 9).alias("angle"))


@query("q_grid", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(greatest(0, least(1000, l_quantity * 1000 / 50))) AS INT) AS x FROM lineitem")
def q_grid(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.grid("l_quantity", F.lit(50.0)).alias("x"))


# ------------------------------------------------------------------ page images, plug-ins

QUERIES |= imaging.QUERIES | plugged.QUERIES
ORACLE |= imaging.ORACLE | plugged.ORACLE
