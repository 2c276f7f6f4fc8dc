"""Parsers: lines (doc_id, ord, text) to records, one function for each layout and strategy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slateledger.functions import constants as C
from slateledger.functions import scalars as S
from slateledger.functions.fuzzy import place
from slateledger.operators.records import KEYS, Line, checkpointed, nth, settled



def in_order():
    """The lines of a document, in order."""
    return Window.partitionBy("doc_id").orderBy("ord")


def before_after(df: DataFrame, text: str, strict: str = C.ID, relaxed: str = C.ID_RELAXED) -> DataFrame:
    """GSTIN with the text before and after it: the strict form first, the relaxed one where there is none."""
    hit = S.first(text, strict)
    pick = lambda make: F.when(F.col("_strict") != "", make(strict)).otherwise(make(relaxed))
    return (
        df.withColumn("_strict", hit)
        .withColumn("GSTIN", F.when(F.col("_strict") != "", F.col("_strict")).otherwise(S.first(text, relaxed)))
        .withColumn("_before", pick(lambda p: F.trim(S.first(text, f"(?s)^(.*?)(?:{p})"))))
        .withColumn("_after", pick(lambda p: F.trim(F.regexp_replace(text, f"(?s)^.*?(?:{p})", ""))))
    )


def body_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines that are neither blank nor headers nor totals."""
    return settled(lines.select(*KEYS, F.trim("text").alias("text")).withColumn("_head", S.header_line("text")), "not _head").drop("_head")


def no_commas(array: Column | str) -> Column:
    return F.transform(S.col(array), lambda a: F.replace(a, F.lit(","), F.lit("")))


# digital layouts


def parse_register(lines: DataFrame) -> DataFrame:
    """Purchase register: date first, number, supplier, identifier, six amounts."""
    step = Line(body_lines(lines), F.col("text")).take("INVOICE_DATE", C.DATE, start=True)
    step.df = settled(step.df, "INVOICE_DATE <> ''").withColumn("_rest", F.regexp_replace("_rest", r"\s+", " "))
    step.take("_number", r"(?:^|\s)(,*(?:\d,*){3,8})(?:\s|$)")
    df = before_after(settled(step.df, "_number <> ''"), "_rest")
    df = df.withColumn("_amounts", no_commas(S.every("_after", C.ITC_AMOUNT)))
    step = Line(df, F.col("_after"))
    step.fields += ["INVOICE_DATE", "GSTIN"]
    step.put("INVOICE_NO", F.replace("_number", F.lit(","), F.lit(""))).put("TRADE_NAME", F.col("_before"))
    for i, f in enumerate(("TAXABLE_VALUE", "IGST", "CGST", "SGST", "CESS", "INVOICE_VALUE")):
        step.put(f, nth("_amounts", i))
    step.put("PLACE_OF_SUPPLY", S.state_name("GSTIN", C.PDF_STATES)).put("SOURCE", "ITC Register")
    return step.records(C.CONFIDENCE["itc"], "direct_pdf_itc", F.col("GSTIN") != "")


def _numbered(df: DataFrame) -> DataFrame:
    """INVOICE_NO, TRADE_NAME and a date inside the number, from the text about the identifier (wide rows)."""
    both = F.concat("_before", F.lit(" "), "_after")
    df = df.withColumn("_raw", S.first(both, C.INVOICE)).withColumn("_at", F.regexp_instr(both, F.lit(C.INVOICE)) - 1)
    df = df.withColumn("_words", F.regexp_replace(F.regexp_replace("_before", r"\s+", " "), r"^(?:\d{1,6}(?: |$))+", ""))
    plain = F.filter(F.split("_words", " "), lambda t: t.rlike(r"^\d{3,8}$"))
    after = F.filter(S.tokens("_after"), lambda t: t.rlike(r"^\d{3,8}$") & ~t.rlike(r"^\d{4}$"))
    df = df.withColumn("_last", F.coalesce(F.try_element_at(plain, F.lit(-1)), F.lit("")))
    cut = F.length("_words") - F.instr(F.reverse("_words"), F.reverse("_last")) - F.length("_last") + 1
    return df.select(
        "*",
        F.when(F.col("_raw") != "", S.clean_invoice("_raw")).when(F.col("_last") != "", F.col("_last")).otherwise(F.coalesce(F.get(after, F.lit(0)), F.lit(""))).alias("INVOICE_NO"),
        F.when(F.col("_raw") != "", S.invoice_date("_raw")).otherwise("").alias("_inner_date"),
        F.when((F.col("_raw") != "") & (F.col("_at") < F.length("_before")), F.trim(F.regexp_replace(F.expr("substring(_before, 1, _at)"), C.ID_RELAXED, "")))
        .when(F.col("_raw") != "", F.col("_before"))
        .when(F.col("_last") != "", F.trim(F.substring("_words", F.lit(1), cut)))
        .otherwise(F.col("_words"))
        .alias("TRADE_NAME"),
    )


def _dated_and_valued(step: Line) -> Line:
    """Type anywhere; date, which is skipped where the number had one; first real amount, and what follows it."""
    step.take("INVOICE_TYPE", C.TYPE, cut=False).take("_own_date", C.DATE)
    step.put("INVOICE_DATE", F.when(F.col("_inner_date") != "", F.col("_inner_date")).otherwise(F.col("_own_date")))
    step.df = step.df.withColumn("_real", S.first_real_amount("_rest"))
    step.df = step.df.withColumn("_rest", F.when(F.col("_real") != "", F.trim(F.expr("substring(_rest, instr(_rest, _real) + length(_real))"))).otherwise(F.col("_rest")))
    step.put("INVOICE_VALUE", F.replace("_real", F.lit(","), F.lit("")))
    return step.take("PLACE_OF_SUPPLY", S.place_pattern(), default=S.state_name("GSTIN", C.PDF_STATES))


def parse_wide(lines: DataFrame) -> DataFrame:
    """One wide row for each invoice, consumed from left to right."""
    df = settled(before_after(body_lines(lines.where(F.col("text").rlike(C.ID_RELAXED))), "text"), "GSTIN <> ''")
    step = Line(_numbered(df), F.col("_after"))
    step.fields += ["GSTIN", "INVOICE_NO", "TRADE_NAME"]
    _dated_and_valued(step).take("REVERSE_CHARGE", r"([NY])\s*", start=True).take("TAX_RATE", C.RATE, start=True)
    open_ = F.lit(True)
    for f in ("TAXABLE_VALUE", "IGST", "CGST", "SGST", "CESS"):
        step.take(f, C.AMOUNT, start=True, when=open_, default="")
        step.df = step.df.withColumn(f, F.replace(f, F.lit(","), F.lit("")))
        open_ = F.col(f) != ""
    step.take("GSTR1_STATUS", r"([YN])\s+", start=True).take("GSTR1_FILING_DATE", C.MONTH_DATE, start=True).take("GSTR1_PERIOD", C.PERIOD, start=True)
    step.take("GSTR3B_STATUS", r"([YN])\s*", start=True).take("_amended", r"([YN])\s+", start=True)
    step.put("AMENDMENT", F.when(F.col("_amended") != "", F.col("_amended")).otherwise("N"))
    step.take("TAX_PERIOD_AMENDED", C.PERIOD, start=True, when=F.col("_amended") != "").take("CANCEL_DATE", C.DATE, start=True)
    step.take("SOURCE", C.SOURCE).take("_irn", C.IRN).put("IRN", F.when(F.col("_irn") != "", F.col("_irn")).otherwise("N/A"))
    step.take("IRN_DATE", C.DATE, when=F.col("_irn") != "")
    return step.records(C.CONFIDENCE["wide"], "direct_pdf")


def page_marks(rows: DataFrame) -> DataFrame:
    """(doc_id, page_no, _a, _b, _c): whether a page (its whole text, or its lines) has a marker of each column group."""
    low = F.lower("text")
    seen = rows.select("doc_id", "page_no", *[S.any_of(low, m).alias(k) for k, m in (("_a", C.GROUP_A_MARKERS), ("_b", C.GROUP_B_MARKERS), ("_c", C.GROUP_C_MARKERS))])
    return seen.groupBy("doc_id", "page_no").agg(*[F.bool_or(k).alias(k) for k in ("_a", "_b", "_c")])


def page_groups(rows: DataFrame) -> DataFrame:
    """(doc_id, n, a, b, c): pages or their lines (doc_id, page_no from 0, text) to the first page of each column group."""
    whole, seen = Window.partitionBy("doc_id"), page_marks(rows)
    seen = seen.withColumn("a", F.min(F.when(F.col("_a"), F.col("page_no"))).over(whole))
    seen = seen.withColumn("b", F.min(F.when(F.col("_b") & (F.col("page_no") > F.col("a")), F.col("page_no"))).over(whole))
    got = seen.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.min("b").alias("b"), F.min(F.when(F.col("_c") & (F.col("page_no") > F.col("b")), F.col("page_no"))).alias("c"))
    third = lambda k: F.floor(F.col("n") * k / 3)
    return got.select("doc_id", "n", F.coalesce("a", F.lit(0)).alias("a"), F.least("n", F.coalesce("b", F.greatest(F.lit(1), third(1)))).alias("b"), F.least("n", F.coalesce("c", F.greatest(F.lit(2), third(2)))).alias("c"))


def parse_group_a(lines: DataFrame) -> DataFrame:
    """Supplier and invoice columns."""
    df = settled(before_after(body_lines(lines.where(F.col("text").rlike(C.ID_RELAXED))), "text"), "GSTIN <> ''")
    raw = S.first("text", C.INVOICE)
    df = df.withColumn("_raw", raw).withColumn("_front", S.first("text", f"(?s)^(.*?)(?:{C.INVOICE})"))
    df = df.select(
        "*",
        F.when(F.col("_raw") != "", S.clean_invoice("_raw")).otherwise(S.invoice_token("_after")).alias("INVOICE_NO"),
        F.when(F.col("_raw") != "", S.invoice_date("_raw")).otherwise("").alias("_inner_date"),
        F.when(F.col("_raw") != "", F.trim(F.regexp_replace(F.trim(F.replace("_front", F.col("GSTIN"), F.lit(""))), C.ID_RELAXED, ""))).otherwise(F.col("_before")).alias("TRADE_NAME"),
    )
    step = Line(df, F.col("_after"))
    step.fields += ["GSTIN", "INVOICE_NO", "TRADE_NAME"]
    _dated_and_valued(step).take("REVERSE_CHARGE", r"\b([NY])\b", cut=False).take("TAX_RATE", C.RATE, cut=False)
    return step.records(C.CONFIDENCE["split"], "direct_pdf", fields=C.FIELDS[:9])


def parse_group_b(lines: DataFrame) -> DataFrame:
    """Amount and filing columns: at least three leading numbers."""
    df = body_lines(lines).where(F.col("text").rlike(r"^\d")).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    df = df.withColumn("_head", S.first("text", r"^((?:[\d,.]+(?: |$))*)")).withColumn("_numbers", F.filter(F.split(F.replace("_head", F.lit(","), F.lit("")), " "), lambda t: t != ""))
    df = df.withColumn("_n", F.size(F.filter(F.split("_head", " "), lambda t: t != "")))
    df = settled(df, "_n >= 3")
    step = Line(df, F.expr("substring(text, length(_head) + 1)"))
    for i, f in enumerate(("TAXABLE_VALUE", "IGST", "CGST", "SGST", "CESS")):
        step.put(f, nth("_numbers", i))
    step.take("GSTR1_STATUS", r"\b([YN])\b").take("GSTR1_FILING_DATE", C.MONTH_DATE).take("GSTR1_PERIOD", C.PERIOD).take("GSTR3B_STATUS", r"\b([YN])\b")
    return step.df.select(*KEYS, *C.FIELDS[9:18])


def parse_group_c(lines: DataFrame) -> DataFrame:
    """Amendment and registration columns: a flag first, at least three words."""
    df = body_lines(lines).where(F.col("text").rlike(r"(?i)^[YN]\b")).withColumn("_t", S.tokens("text")).where("size(_t) >= 3")
    given = lambda i: F.when(F.upper(F.get("_t", F.lit(i))) != "N/A", F.get("_t", F.lit(i))).otherwise("N/A")
    step = Line(df, F.col("text")).put("AMENDMENT", F.upper(F.get("_t", F.lit(0)))).put("TAX_PERIOD_AMENDED", given(1)).put("CANCEL_DATE", given(2))
    step.take("SOURCE", C.SOURCE, cut=False).take("_irn", C.IRN).put("IRN", F.when(F.col("_irn") != "", F.col("_irn")).otherwise("N/A"))
    step.take("IRN_DATE", C.DATE, when=F.col("_irn") != "")
    return step.df.select(*KEYS, *C.FIELDS[18:])


def zip_groups(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """Rows of a document put side by side by position; missing sides have their defaults, a missing first
    side stays null until normalisation."""
    at = lambda df: df.withColumn("_at", F.row_number().over(in_order())).drop("ord")
    drop = [x for x in ("_confidence", "_source") if x in a.columns]
    out = at(a.drop(*drop)).join(at(b), ["doc_id", "_at"], "full_outer").join(at(c), ["doc_id", "_at"], "full_outer")
    sides = [F.col(f) for f in C.FIELDS[:9]] + [F.coalesce(f, F.lit(C.DEFAULTS.get(f, ""))).alias(f) for f in C.FIELDS[9:]]
    return out.select("doc_id", F.col("_at").alias("ord"), *sides, F.lit(C.CONFIDENCE["split"]).alias("_confidence"), F.lit("direct_pdf").alias("_source"))


def parse_split(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page_no from 0, ord, text): groups of pages hold groups of columns of the same rows."""
    own = lines.join(page_groups(lines), "doc_id")  # markers lie within lines, so no page's text is put together
    cut = lambda lo, hi: own.where((F.col("page_no") >= F.col(lo)) & (F.col("page_no") < F.col(hi))).select(*KEYS, "text")
    return zip_groups(parse_group_a(cut("a", "b")), parse_group_b(cut("b", "c")), parse_group_c(cut("c", "n")))


# image strategies


def after_id(df: DataFrame, rest: Column, source: str | Column = "ocr_image") -> DataFrame:
    """A record from what follows a valid identifier (GSTIN): name, number, type, date, amounts, place, rate, charge."""
    step = Line(df, rest)
    step.fields.append("GSTIN")
    step.df = step.df.withColumn("_n", S.name_end("_rest"))
    step.put("TRADE_NAME", F.when(F.col("_n") > 0, F.trim(F.expr("substring(_rest, 1, _n)"))).otherwise(""))
    step.df = step.df.withColumn("_rest", F.when(F.col("_n") > 0, F.trim(F.expr("substring(_rest, _n + 1)"))).otherwise(F.col("_rest")))
    step.take("INVOICE_NO", C.IMAGE_INVOICE, when=S.first("_rest", C.IMAGE_INVOICE) != F.col("GSTIN"))
    step.take("INVOICE_TYPE", C.TYPE, start=True).take("INVOICE_DATE", C.IMAGE_DATE)
    step.df = step.df.withColumn("_amounts", S.image_amounts("_rest"))
    for i, f in enumerate(("INVOICE_VALUE", "TAXABLE_VALUE", "IGST", "CGST", "SGST", "CESS")):
        step.put(f, nth("_amounts", i))
    step.put("PLACE_OF_SUPPLY", place("_rest")).take("TAX_RATE", C.IMAGE_RATE, cut=False).take("REVERSE_CHARGE", r"\b([YN])\b", cut=False)
    return step.records(C.CONFIDENCE["line"], source)


def _with_id(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows whose first match of the pattern, repaired, is a valid identifier."""
    return settled(df.withColumn("GSTIN", S.repair_id(S.first(text, pattern))), S.valid_id("GSTIN"))


def _after(text: str, pattern: str) -> Column:
    return F.regexp_replace(text, f"(?s)^.*?(?:{pattern})", "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Strategy 1: lines that begin with an identifier, perhaps after a serial number."""
    df = lines.select(*KEYS, F.trim("text").alias("text")).where("length(text) >= 15")
    df = df.withColumn("text", F.when(S.first("text", "^(?:" + C.ID + ")") == "", F.regexp_replace("text", r"^\d{1,3}\s+", "")).otherwise(F.col("text")))
    return after_id(_with_id(df, "text", "^(?:" + C.ID + ")"), _after("text", "^(?:" + C.ID + ")"))


def document_text(lines: DataFrame) -> DataFrame:
    """(doc_id, text): a document's lines, joined; a document is a task's unit from here on."""
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))


def blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, text): from each identifier to the next, white space unified."""
    inner = C.ID.replace("(", "(?:", 1)
    cut = document_text(lines).select("doc_id", F.posexplode(F.split("text", f"(?={inner})")).alias("ord", "text"))
    return cut.where(F.col("text").rlike("^" + inner)).select(*KEYS, F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def parse_blocks(lines: DataFrame) -> DataFrame:
    """Strategy 2: records from blocks."""
    return after_id(_with_id(blocks(lines), "text", "^(?:" + C.ID + ")"), _after("text", C.ID))


def contexts(lines: DataFrame, before: int = 0, after: int = 4) -> DataFrame:
    """(doc_id, ord, text, context): each line with those about it, trimmed and joined."""
    joined = F.array_join(F.transform(F.collect_list("text").over(in_order().rowsBetween(-before, after)), lambda t: F.trim(t)), " ")
    return lines.select(*KEYS, "text", joined.alias("context"))


def parse_anchored(lines: DataFrame) -> DataFrame:
    """Strategy 3: identifiers anywhere, read on into the four lines that follow."""
    df = contexts(lines).where(S.strict_id("text") != "")
    return after_id(_with_id(df, "text", C.ID), _after("context", C.ID))


def minimal(df: DataFrame, context: str) -> DataFrame:
    """A record of few fields from the text about a rebuilt identifier (GSTIN)."""
    df = df.withColumn("_amounts", S.image_amounts(context)).withColumn("_inv", S.first(context, C.IMAGE_INVOICE))
    step = Line(df, F.col(context))
    step.fields.append("GSTIN")
    step.put("INVOICE_DATE", S.first(context, C.IMAGE_DATE)).put("INVOICE_VALUE", nth("_amounts", 0)).put("TAXABLE_VALUE", nth("_amounts", 1))
    step.put("INVOICE_NO", F.when(F.col("_inv") != F.col("GSTIN"), F.col("_inv")).otherwise("")).put("PLACE_OF_SUPPLY", place(context))
    return step.records(C.CONFIDENCE["rebuilt"], "reconstructed_ocr")


#: Tokens of a stretch that windows begin in.
STRETCH = 64


def token_windows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, tokens): (doc_id, size, at, merged, context) for runs of 2, 3 and 4 tokens that collapse to 15 characters
    and more. Documents are cut into stretches that have the two tokens before and the eleven after them, so that a window
    is cut from a short array and nothing is sorted or moved; each token is collapsed once, and contexts are put
    together only for windows that are long enough. (Of posexplode Spark infers filters that would collapse all tokens again.)"""
    first = F.sequence(F.lit(0), F.floor((F.size("tokens") - 2) / STRETCH).cast("int"))
    cut = docs.where(F.size("tokens") >= 2).select("doc_id", "tokens", F.explode(first).alias("_k")).withColumn("_at", F.col("_k") * STRETCH).withColumn("_b", F.least("_at", F.lit(2)))
    cut = cut.select("doc_id", "_at", "_b", F.slice("tokens", F.col("_at") - F.col("_b") + 1, F.col("_b") + STRETCH + 11).alias("_t"))
    plain = cut.withColumn("_m", F.transform("_t", lambda t: F.regexp_replace(F.upper(t), "[^A-Z0-9]", "")))
    each = plain.select("*", F.posexplode_outer("_m").alias("_i", "_0")).where((F.col("_i") >= F.col("_b")) & (F.col("_i") < F.col("_b") + STRETCH) & (F.col("_i") + 2 <= F.size("_m")))
    for k in (1, 2, 3):
        each = each.withColumn(f"_{k}", F.concat(f"_{k - 1}", F.get("_m", F.col("_i") + k)))  # null beyond the last token
    runs = each.select("doc_id", "_t", "_i", (F.col("_at") - F.col("_b") + F.col("_i")).alias("at"), F.inline(F.array(*[F.struct(F.lit(k + 1).alias("size"), F.col(f"_{k}").alias("merged")) for k in (1, 2, 3)])))
    before = F.least("at", F.lit(2))
    around = F.array_join(F.slice("_t", F.col("_i") - before + 1, before + F.col("size") + 8), " ")
    return runs.where("length(merged) >= 15").select("doc_id", "size", "at", "merged", around.alias("context"))


def parse_rebuilt(lines: DataFrame, use_lines_as_tokens: bool = False) -> DataFrame:
    """Strategy 4: identifiers torn apart, rebuilt from neighbouring tokens, then from whole lines.

    Tokens are the recognised lines where there are any, else words. The same identifier comes once for
    each window that holds it.
    """
    found = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("_l"))
    cut = F.transform("_l", lambda t: F.trim(t)) if use_lines_as_tokens else F.flatten(F.transform("_l", lambda t: F.split(t, r"\s+")))
    windows = token_windows(found.select("doc_id", F.filter(cut, lambda t: t != "").alias("tokens"))).where(F.col("merged").rlike(C.ID_COLLAPSED))
    far = F.lit(1 << 40)
    pieces = windows.select("doc_id", (F.col("size") * far + F.col("at")).alias("ord"), F.col("merged").alias("joined"), "context")
    whole = lines.select("doc_id", (F.lit(5) * far + F.col("ord")).alias("ord"), F.regexp_replace("text", r"\s+", "").alias("joined"), F.col("text").alias("context"))
    return minimal(_with_id(pieces.unionByName(whole), "joined", C.ID_COLLAPSED), "context")


def row_clusters(boxes: DataFrame, reach: float = 20.0) -> DataFrame:
    """boxes (doc_id, pos, text, xc, yc): (doc_id, ord, text), boxes near a row's first box joined from left to right.

    Boxes come in order of height; one joins the row whose first box is less than `reach` above it.
    """
    box = F.struct("yc", "pos", "xc", "text")
    ordered = boxes.where("trim(text) <> '' and xc is not null and yc is not null").withColumn("text", F.trim("text")).groupBy("doc_id").agg(F.array_sort(F.collect_list(box)).alias("b"))
    begin = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["y"].isNull() | (F.abs(x["y"] - acc["y"]) >= reach)
        return F.when(new, F.struct(x["y"].alias("y"), F.concat(acc["starts"], F.array(x["i"])).alias("starts"))).otherwise(acc)

    heights = F.transform("b", lambda x, i: F.struct(x["yc"].alias("y"), i.alias("i")))  # only rows' first boxes are gathered
    placed = ordered.select("doc_id", F.aggregate(heights, begin, step)["starts"].alias("s"), "b")
    ends = F.concat(F.slice("s", F.lit(2), F.size("s")), F.array(F.size("b")))
    cut = F.transform(F.arrays_zip("s", ends.alias("e")), lambda r: F.slice("b", r["s"] + 1, r["e"] - r["s"]))  # a row's boxes are neighbours
    rows = placed.select("doc_id", F.posexplode_outer(cut).alias("k", "r"))  # of posexplode Spark infers filters that cut again
    text = F.array_join(F.transform(F.array_sort(F.transform("r", lambda z: F.struct(z["xc"], z["yc"], z["pos"], z["text"]))), lambda x: x["text"]), " ")
    return rows.select("doc_id", (F.col("k") + 1).cast("long").alias("ord"), text.alias("text"))


def parse_columns(boxes: DataFrame) -> DataFrame:
    """Strategy 5: rows of boxes; torn identifiers give minimal records."""
    rows = row_clusters(boxes)
    strict = _with_id(rows.where(S.strict_id("text") != ""), "text", C.ID)
    torn = rows.where(S.strict_id("text") == "").withColumn("joined", F.regexp_replace("text", r"\s+", ""))
    return after_id(strict, _after("text", C.ID)).unionByName(minimal(_with_id(torn, "joined", C.ID_COLLAPSED), "text"))


def _bill(df: DataFrame) -> DataFrame:
    """df (doc_id, ord, text, prev, next) with a bill number in text."""
    step = Line(df, F.col("text")).take("INVOICE_NO", C.BILL_NO, cut=False).take("INVOICE_DATE", C.IMAGE_DATE)
    step.df = step.df.withColumn("_a", S.image_amounts("_rest")).withColumn("_low", F.lower("_rest"))
    for i, f in enumerate(("TAXABLE_VALUE", "IGST", "CGST", "SGST")):
        step.put(f, nth("_a", i))
    step.put("INVOICE_VALUE", F.when(F.size("_a") >= 5, F.try_element_at("_a", F.lit(-1))).otherwise(nth("_a", 0))).put("PLACE_OF_SUPPLY", place("_rest"))
    pick = lambda names, other: F.coalesce(*[F.when(F.contains("_low", F.lit(n.lower())), n) for n in names], F.lit(other))
    step.put("INVOICE_TYPE", pick(C.TRANSPORT_MODES, "R")).put("GSTR1_STATUS", pick(C.BILL_STATUSES, ""))
    step.df = step.df.withColumn("_id", S.repair_id(S.strict_id(F.concat_ws(" ", "prev", "_rest", "next"))))
    step.put("GSTIN", F.when(S.valid_id("_id"), F.col("_id")).otherwise("")).take("TAX_RATE", C.IMAGE_RATE, cut=False)
    return step.records(C.CONFIDENCE["bill"], "eway_bill", F.col("INVOICE_VALUE") != "")


def _bill_lines(lines: DataFrame) -> DataFrame:
    df = lines.select(*KEYS, F.trim("text").alias("text"), F.lag("text").over(in_order()).alias("prev"), F.lead("text").over(in_order()).alias("next"))
    df = settled(df.withColumn("_head", S.bill_header_line("text")).withColumn("_bill", S.first("text", C.BILL_NO) != ""), "length(text) >= 10 and not _head")
    return _bill(df.where("_bill")).unionByName(after_id(_with_id(df.where("not _bill"), "text", C.ID), _after("text", C.ID), "eway_bill_gstin"))


def _bill_rows(rows: DataFrame) -> DataFrame:
    rows = rows.where(~S.bill_header_line("text")).withColumn("prev", F.lit(None).cast("string")).withColumn("next", F.lit(None).cast("string")).withColumn("_bill", S.first("text", C.BILL_NO) != "")
    return _bill(rows.where("_bill")).unionByName(after_id(_with_id(rows.where("not _bill"), "text", C.ID), _after("text", C.ID)))


def parse_bills(lines: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Strategy 6: lines with a bill number, else with an identifier; from rows of boxes where that finds more.

    Which of the two a document is read from is settled by counts, so that its fields are read once; rows of
    boxes are put together once, in the checkpoint folder.
    """
    if boxes is None:
        return _bill_lines(lines)
    rows = checkpointed(row_clusters(boxes, 25.0))
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    use = n(_bill_rows(rows), "_o").join(n(_bill_lines(lines), "_g"), "doc_id", "left").where("coalesce(_g, 0) < 3 and _o > coalesce(_g, 0)").select("doc_id")
    return _bill_lines(lines.join(use, "doc_id", "left_anti")).unionByName(_bill_rows(rows.join(use, "doc_id", "left_semi")))


def parse_generic(lines: DataFrame) -> DataFrame:
    """Strategy 7: any line with a plausible amount and a date, an identifier or a bill number."""
    df = lines.select(*KEYS, F.trim("text").alias("text")).withColumn("_skip", S.any_of(F.lower("text"), C.GENERIC_SKIP))
    df = settled(df, "length(text) >= 15 and not _skip")
    df = df.withColumn("_a", S.image_amounts("text")).withColumn("_id", S.strict_id("text")).withColumn("_n", F.size("_a"))
    step = Line(df, F.col("text")).put("INVOICE_NO", S.first("text", C.BILL_NO)).put("INVOICE_DATE", S.first("text", C.IMAGE_DATE))
    step.df = settled(step.df, "_n > 0 and (INVOICE_DATE <> '' or _id <> '' or INVOICE_NO <> '')").withColumn("_fixed", S.repair_id("_id"))
    step.put("GSTIN", F.when(S.valid_id("_fixed"), F.col("_fixed")).otherwise(""))
    step.put("TAXABLE_VALUE", F.when(F.col("_n") >= 2, nth("_a", 0)).otherwise("")).put("IGST", F.when(F.col("_n") >= 3, nth("_a", 1)).otherwise(""))
    step.put("CGST", F.when(F.col("_n") >= 4, nth("_a", 2)).otherwise("")).put("SGST", F.when(F.col("_n") >= 4, nth("_a", 3)).otherwise(""))
    step.put("INVOICE_VALUE", F.try_element_at("_a", F.lit(-1))).put("PLACE_OF_SUPPLY", place("text")).take("TAX_RATE", C.IMAGE_RATE, cut=False)
    kept = reduce(lambda a, b: a | b, [F.col("GSTIN") != "", F.col("INVOICE_NO") != "", F.col("INVOICE_DATE") != ""])
    return step.records(C.CONFIDENCE["generic"], "generic_table", kept)


PLAIN_ID = r"\b(\d{2}[A-Z0-9]{13})\b"


def _paired(docs: DataFrame, found: Column, per_row: int) -> DataFrame:
    """What was found in a document's text, each with the date and the amounts at its place."""
    lists = docs.select("doc_id", found.alias("_g"), S.every("text", C.DATE).alias("_d"), no_commas(S.every("text", C.PLAIN_AMOUNT)).alias("_a"))
    rows = lists.select("doc_id", F.posexplode("_g").alias("ord", "_found"), "_d", "_a")  # the lists are found once a document
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
    second = at("_a", F.col("ord") * per_row + 1) if per_row > 1 else F.lit("")
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), "_found", at("_d", F.col("ord")).alias("INVOICE_DATE"), at("_a", F.col("ord") * per_row).alias("INVOICE_VALUE"), second.alias("TAXABLE_VALUE"))


def _bare(rows: DataFrame, gstin: Column, invoice: Column, confidence: float, source: str, label: str) -> DataFrame:
    step = Line(rows, F.lit(""))
    step.fields += ["INVOICE_DATE", "INVOICE_VALUE", "TAXABLE_VALUE"]
    return step.put("GSTIN", gstin).put("INVOICE_NO", invoice).put("SOURCE", source).records(confidence, label)


def emergency(docs: DataFrame, source: str = "image_regex_fallback", label: str = "image_emergency_regex") -> DataFrame:
    """docs (doc_id, text): the i-th identifier with the i-th date and amounts 2i and 2i + 1."""
    rows = _paired(docs, S.every("text", PLAIN_ID), 2)
    return _bare(rows, F.col("_found"), F.concat(F.lit("UNKNOWN-"), (F.col("ord") + 1).cast("string")), C.CONFIDENCE["emergency"], source, label)


def emergency_with_bills(docs: DataFrame) -> DataFrame:
    """The same; documents without an identifier by their bill numbers, each with the date and amount at its place."""
    known = F.size(S.every("text", PLAIN_ID)) > 0
    bills = _paired(docs.where(~known), S.every("text", C.BILL_NO), 1)
    return emergency(docs, "regex_fallback", "emergency_regex_fallback").unionByName(_bare(bills, F.lit(""), F.col("_found"), 0.25, "eway_bill_fallback", "emergency_ewb_fallback"))
