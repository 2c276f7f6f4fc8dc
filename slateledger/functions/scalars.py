"""Column rules: identifiers, numbers, dates, keywords, places, matches. Column -> Column, no Python functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slateledger.functions import constants as C


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The first match's group, or the empty string."""
    return F.regexp_extract(col(text), pattern, group)


def every(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(1))


def number(text: Column | str) -> Column:
    """A number without its commas; null where it is none."""
    return F.replace(col(text), F.lit(","), F.lit("")).try_cast("double")


def money(text: Column | str) -> Column:
    """Amounts add up as decimals."""
    return F.replace(col(text), F.lit(","), F.lit("")).try_cast("decimal(15,2)")


def keywords(text: Column | str, words: list[str]) -> Column:
    """How many of the words a text contains."""
    return reduce(lambda a, b: a + b, [F.contains(col(text), F.lit(w)).cast("int") for w in words])


def any_of(text: Column | str, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col(text), F.lit(w)) for w in words])


# identifiers


def strict_id(text: Column | str) -> Column:
    return first(text, C.ID)


def any_id(text: Column | str) -> Column:
    """The strict form first, the relaxed one where there is none."""
    return F.coalesce(F.nullif(strict_id(text), F.lit("")), first(text, C.ID_RELAXED))


def valid_id(gstin: Column | str) -> Column:
    """Known state code, letters and digits in their places, Z as the fourteenth character."""
    g = col(gstin)
    return (F.length(g) == 15) & F.substring(g, 1, 2).isin(list(C.IMAGE_STATES)) & g.rlike(r"^.{2}[A-Za-z]{5}[0-9]{4}[A-Za-z].Z.$")


def valid_id_calibration(gstin: Column | str) -> Column:
    """The evaluation's own rule: a digit as the thirteenth character, state 1 to 38."""
    g = F.upper(F.trim(col(gstin)))
    return g.rlike(r"^\d{2}[A-Z]{5}\d{4}[A-Z]\dZ[A-Z0-9]$") & F.coalesce(F.substring(g, 1, 2).try_cast("int").between(1, 38), F.lit(False))


def repair_id(gstin: Column | str) -> Column:
    """Undo misread characters where the place demands a letter or a digit; 15 characters only."""
    g = F.upper(F.replace(col(gstin), F.lit(" "), F.lit("")))
    part = lambda a, n: F.substring(g, a, n)
    fixed = F.concat(part(1, 2), F.translate(part(3, 5), "018", "OIB"), F.translate(part(8, 4), "OISZ", "0152"), F.translate(part(12, 1), "01", "OI"), part(13, 1), F.translate(part(14, 1), "27", "ZZ"), part(15, 1))
    return F.when(F.length(g) == 15, fixed).otherwise(g)


# invoice numbers


def clean_invoice(raw: Column | str) -> Column:
    """Cut at an embedded date, without a trailing type code and separators, in capitals."""
    r = F.regexp_replace(col(raw), "(?s)" + C.DATE_ANYWHERE + ".*$", "")
    r = F.regexp_replace(r, r"(?i)([A-Z0-9])(?:R|DE|SEWP|SEZWP|SEZWOP|CBW|RE)$", "$1")
    return F.upper(F.trim(F.regexp_replace(r, r"[-/ ]+$", "")))


def invoice_date(raw: Column | str) -> Column:
    return first(raw, C.DATE_ANYWHERE)


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(col(text), r"\s+"), lambda t: t != "")


def invoice_token(text: Column | str) -> Column:
    """The first token of 3 to 8 digits."""
    return F.coalesce(F.get(F.filter(tokens(text), lambda t: t.rlike(r"^\d{3,8}$")), F.lit(0)), F.lit(""))


# amounts


def image_amounts(text: Column | str) -> Column:
    """Amounts of 10 and more, without commas; digits in runs of four and more without commas don't count."""
    return F.filter(F.transform(every(text, C.IMAGE_AMOUNT), lambda a: F.replace(a, F.lit(","), F.lit(""))), lambda a: a.try_cast("double") >= 10)


def first_real_amount(text: Column | str) -> Column:
    """The first amount of 100 and more, as written; smaller ones are row numbers."""
    return F.coalesce(F.get(F.filter(every(text, C.AMOUNT), lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double") >= 100), F.lit(0)), F.lit(""))


def recalculated(value: Column | str, *parts: Column | str) -> Column:
    """The parts' sum where it is above 100 and the value is zero or below a hundredth of it."""
    amount = lambda c: F.coalesce(F.replace(col(c), F.lit(","), F.lit("")).try_cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))
    total, v = reduce(lambda a, b: a + b, map(amount, parts)), amount(value)
    return F.when((total > 100) & ((v == 0) | ((v > 0) & (v * 100 < total))), total.cast("decimal(15,2)").cast("string")).otherwise(col(value))


# lines and documents


def header_line(line: Column | str) -> Column:
    low = F.trim(F.lower(col(line)))
    return (low == "") | (keywords(low, C.HEADER_KEYWORDS) >= 2) | low.rlike(C.HEADER_LINE)


def bill_header_line(line: Column | str) -> Column:
    low = F.trim(F.lower(col(line)))
    return any_of(low, C.EWB_HEADERS) & (F.length(low) < 100)


def document_format(text: Column | str) -> Column:
    low = F.lower(col(text))
    return (
        F.when(keywords(low, C.EWB_KEYWORDS) >= 2, "eway_bill")
        .when(keywords(low, C.STATEMENT_KEYWORDS) >= 2, "gst2a")
        .when(F.size(every(text, C.BILL_NO)) >= 3, "eway_bill")
        .when(F.size(every(text, C.ID)) >= 2, "gst2a")
        .otherwise("unknown")
    )


def statement_format(first_pages: Column | str, n_pages: Column | str) -> Column:
    low = F.lower(col(first_pages))
    both = any_of(low, C.GROUP_A_MARKERS) & any_of(low, C.GROUP_B_MARKERS)
    return F.when(any_of(low, C.ITC_MARKERS), "ITC").when(both | (col(n_pages) <= 2), "B").otherwise("A")


def variant_count(quality: Column | str) -> Column:
    return F.when(col(quality) >= 0.75, 2).when(col(quality) >= 0.45, 4).otherwise(7)


#: Width below which pages are enlarged, and above which they are reduced (one and a half times as much for heights).
TARGET_WIDTH, MAX_WIDTH = 3000, 6000
#: Variants of a page by its quality: clean, medium, poor; the page as it came is tried last.
VARIANTS = [["colour", "clahe"], ["colour", "binary", "clahe", "table"], ["colour", "binary", "denoise", "clahe", "shadow_binary", "table", "ocr_binary"]]


def upright_size(width: Column, height: Column, orientation: Column) -> Column:
    """Struct (w, h) of a picture after its orientation mark is applied: marks 5 to 8 lie on their side."""
    side = F.coalesce(orientation, F.lit(1)).between(5, 8)
    return F.struct(F.when(side, height).otherwise(width).alias("w"), F.when(side, width).otherwise(height).alias("h"))


def page_size(width: Column, height: Column) -> Column:
    """Struct (w, h) of a page that is read: reduced to fit 6000 by 9000, then enlarged to a width of 3000, by four at
    most; whole pixels, cut."""
    least = F.least(MAX_WIDTH / width, MAX_WIDTH * 1.5 / height)
    big = (width > MAX_WIDTH) | (height > MAX_WIDTH * 1.5)
    w, h = (F.when(big, (c * least).cast("int")).otherwise(c.cast("int")) for c in (width, height))
    factor = F.when(w < TARGET_WIDTH, F.least(TARGET_WIDTH / w, F.lit(4.0))).otherwise(F.lit(1.0))
    return F.struct((w * factor).cast("int").alias("w"), (h * factor).cast("int").alias("h"))


def variant_names(quality: Column | str) -> Column:
    """The variants made of a page, in order, and the page itself last."""
    names = lambda k: F.array(*map(F.lit, [*VARIANTS[k], "original"]))
    return F.when(col(quality) >= 0.75, names(0)).when(col(quality) >= 0.45, names(1)).otherwise(names(2))


def quality_score(sharpness: Column, contrast: Column, brightness: Column, noise: Column) -> Column:
    """Weighted quality from raw measures, each first brought to 0..1."""
    zero, one = F.lit(0.0), F.lit(1.0)
    s, c = F.least(sharpness / 500, one), F.least(contrast / 60, one)
    b, n = F.greatest(zero, 1 - F.abs(brightness - 185) / 185), F.greatest(zero, 1 - noise / 20)
    return F.round(F.least(s * 0.35 + c * 0.30 + b * 0.20 + n * 0.15, one), 3)


def deskew_angle(angles: Column | str) -> Column:
    """Median of the near-level angles (up to 5 degrees); 0 for fewer than 3 of them or below 0.3 degrees."""
    level = F.array_sort(F.filter(col(angles), lambda a: F.abs(a) <= 5))
    n = F.size(level)
    mid = (F.element_at(level, ((n + 1) / 2).cast("int")) + F.element_at(level, (n / 2 + 1).cast("int"))) / 2
    return F.when((n >= 3) & (F.abs(F.when(n >= 3, mid)) >= 0.3), mid).otherwise(F.lit(0.0))


# places and names


def state_name(gstin: Column | str, states: dict[str, str]) -> Column:
    """The state of an identifier's code, or the empty string; a literal map of fixed size."""
    table = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    return F.coalesce(F.element_at(table, F.substring(col(gstin), 1, 2)), F.lit(""))


def place_contained(text: Column | str) -> Column:
    """The first known place, in code order, that a text contains anywhere, in any case."""
    low = F.lower(col(text))
    chain = None
    for name in dict.fromkeys(C.IMAGE_STATES.values()):
        here = F.contains(low, F.lit(name.lower()))
        chain = F.when(here, name) if chain is None else chain.when(here, name)
    return chain.otherwise("")


def place_pattern() -> str:
    return "((?i:" + "|".join(sorted(C.PDF_PLACES, key=len, reverse=True)) + "))"


def name_end(text: Column | str) -> Column:
    """Characters before a date, a number of three digits and more, an invoice prefix or a lone R."""
    return F.greatest(F.regexp_instr(col(text), F.lit(C.NAME_END)) - 1, F.lit(0))


# evaluation


def norm_amount(text: Column | str) -> Column:
    return F.coalesce(number(F.trim(col(text))), F.lit(0.0))


def norm_id(text: Column | str) -> Column:
    return F.substring(F.upper(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", "")), 1, 15)


def norm_invoice(text: Column | str) -> Column:
    return F.upper(F.trim(F.coalesce(col(text), F.lit(""))))


def norm_date(text: Column | str) -> Column:
    return F.replace(F.trim(F.coalesce(col(text), F.lit(""))), F.lit("/"), F.lit("-"))


#: Fields that are compared, and how.
MATCHED = {"GSTIN": norm_id, "INVOICE_NO": norm_invoice, "INVOICE_DATE": norm_date, "INVOICE_VALUE": norm_amount, "TAXABLE_VALUE": norm_amount, "IGST": norm_amount, "CGST": norm_amount, "SGST": norm_amount}


def field_match(field: str, truth: Column, predicted: Column) -> Column:
    """Exact and not blank; amounts within one per cent, both zero included."""
    norm = MATCHED[field]
    t, p = norm(truth), norm(predicted)
    if norm is not norm_amount:
        return (t == p) & (t != "")
    return F.when((t == 0) & (p == 0), True).when(t == 0, False).otherwise(F.abs(t - p) / F.greatest(F.abs(t), F.lit(1e-6)) < 0.01)


# reports


def flat(value: Column | str) -> Column:
    """Trimmed text; null, none and nan as blank."""
    s = F.trim(F.coalesce(col(value).cast("string"), F.lit("")))
    return F.when(F.lower(s).isin("none", "nan"), "").otherwise(s)


def display_name(path: Column | str) -> Column:
    """A file's stem without the job's id in front."""
    stem = F.regexp_replace(F.regexp_replace(col(path), r"^.*[/\\]", ""), r"(.)\.[^.]*$", "$1")
    return F.regexp_replace(stem, r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}_", "")


def sanitised(name: Column | str) -> Column:
    """A file name of word characters, dots and dashes only; a long one as the start of its stem and its suffix."""
    safe = F.regexp_replace(col(name), r"[^\w.\-]", "_")
    suffix = F.regexp_extract(safe, r"^.+(\.[^.]+)$", 1)
    return F.when(F.length(safe) > 100, F.concat(F.substring(F.left(safe, F.length(safe) - F.length(suffix)), 1, 90), suffix)).otherwise(safe)


def rupees(amount: Column | str) -> Column:
    a = col(amount).cast("decimal(20,2)")
    return F.when(F.coalesce(a, F.lit(0)) == 0, "₹0.00").otherwise(F.concat(F.lit("₹"), F.format_number(a, 2)))


def grid(x: Column | str, width: Column | str) -> Column:
    """A coordinate on a grid of 0 to 1000."""
    return F.greatest(F.lit(0), F.least(F.lit(1000), (col(x) * 1000 / col(width)).cast("int")))
