"""SQL for the oracle that reads lines step by step, as the parsers do."""

from __future__ import annotations

from slateledger.functions import constants as C


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def first(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {lit(pattern)}, {group})"


def drop(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, '')"


def every(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, 1)"


def image_amounts(text: str) -> str:
    return f"[replace(a, ',', '') FOR a IN {every(text, C.IMAGE_AMOUNT)} IF CAST(replace(a, ',', '') AS DOUBLE) >= 10]"


def states(expr: str, table: dict[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " ELSE '' END"


def place(text: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({text}), '{n.lower()}') THEN '{n}'" for n in dict.fromkeys(C.IMAGE_STATES.values())) + " ELSE '' END"


def near_place(text: str) -> str:
    """The same for text that may begin or end within a name: of the names' parts only one is close enough to count."""
    return f"CASE WHEN {place(text)} <> '' THEN {place(text)} WHEN regexp_matches(lower({text}), '(^| )and kashmir( |$)') THEN 'Jammu and Kashmir' ELSE '' END"


def count_words(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {lit(w)}) AS INT)" for w in words) + ")"


def any_word(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def header(line: str) -> str:
    low = f"trim(lower({line}))"
    return f"({low} = '' OR {count_words(low, C.HEADER_KEYWORDS)} >= 2 OR regexp_matches({low}, {lit(C.HEADER_LINE)}))"


def valid_id(g: str) -> str:
    return f"(length({g}) = 15 AND substring({g}, 1, 2) IN ({', '.join(map(lit, C.IMAGE_STATES))}) AND regexp_matches({g}, '^.{{2}}[A-Za-z]{{5}}[0-9]{{4}}[A-Za-z].Z.$'))"


def repair(g: str) -> str:
    u = f"upper(replace({g}, ' ', ''))"
    part = lambda a, n: f"substring({u}, {a}, {n})"
    return f"CASE WHEN length({u}) = 15 THEN {part(1, 2)} || translate({part(3, 5)}, '018', 'OIB') || translate({part(8, 4)}, 'OISZ', '0152') || translate({part(12, 1)}, '01', 'OI') || {part(13, 1)} || translate({part(14, 1)}, '27', 'ZZ') || {part(15, 1)} ELSE {u} END"


def clean_invoice(raw: str) -> str:
    r = drop(raw, "(?s)" + C.DATE_ANYWHERE + ".*$")
    r = f"regexp_replace({r}, '(?i)([A-Z0-9])(?:R|DE|SEWP|SEZWP|SEZWOP|CBW|RE)$', '\\1')"
    return f"upper(trim({drop(r, '[-/ ]+$')}))"


def real_amount(text: str) -> str:
    return f"coalesce([a FOR a IN {every(text, C.AMOUNT)} IF CAST(replace(a, ',', '') AS DOUBLE) >= 100][1], '')"


class Steps:
    """Common table expressions, each a projection over the one before."""

    def __init__(self, ctes: str, select: str):
        self.parts, self.n, self.fields = [ctes], 0, []
        self._next(select)

    def _next(self, select: str) -> Steps:
        self.n += 1
        self.parts.append(f"s{self.n} AS ({select})")
        return self

    def add(self, **cols: str) -> Steps:
        for k, v in cols.items():
            if k in self.fields:
                self._next(f"SELECT * REPLACE ({v} AS {k}) FROM s{self.n}")
            else:
                self._next(f"SELECT *, {v} AS {k} FROM s{self.n}")
                self.fields.append(k)
        return self

    def where(self, cond: str) -> Steps:
        return self._next(f"SELECT * FROM s{self.n} WHERE {cond}")

    def take(self, field: str, pattern: str, start: bool = False, cut: bool = True, when: str = "TRUE", default: str | None = None) -> Steps:
        other = lit(C.DEFAULTS.get(field, "")) if default is None else default
        hit = f"CASE WHEN {when} THEN {first('rest', '^(?:' + pattern + ')' if start else pattern)} ELSE '' END"
        self.add(hit=hit)
        self.add(**{field: f"CASE WHEN hit <> '' THEN hit ELSE {other} END"})
        if cut:
            self.add(rest=f"CASE WHEN hit <> '' THEN trim({drop('rest', ('^(?:' if start else '(?s)^.*?(?:') + pattern + ')')}) ELSE rest END")
        return self

    def split_at_id(self, text: str) -> Steps:
        pick = lambda make: f"CASE WHEN strict <> '' THEN {make(C.ID)} ELSE {make(C.ID_RELAXED)} END"
        self.add(strict=first(text, C.ID))
        self.add(GSTIN=f"CASE WHEN strict <> '' THEN strict ELSE {first(text, C.ID_RELAXED)} END")
        self.add(before_=pick(lambda p: f"trim({first(text, f'(?s)^(.*?)(?:{p})')})"))
        return self.add(after_=pick(lambda p: f"trim({drop(text, f'(?s)^.*?(?:{p})')})"))

    def records(self, confidence: float, source: str, where: str = "TRUE") -> str:
        cols = [f if f in self.fields else f"{lit(C.DEFAULTS.get(f, ''))} AS {f}" for f in C.FIELDS]
        return ", ".join(self.parts) + f" SELECT doc_id, CAST(ord AS BIGINT) AS ord, {', '.join(cols)}, CAST({confidence} AS DOUBLE) AS _confidence, {lit(source)} AS _source FROM s{self.n} WHERE {where}"


#: The first of the steps within another statement's table.
INNER = "WITH one AS (SELECT 1)"


def after_id(s: Steps) -> Steps:
    s.add(n_=f"length(regexp_extract(rest, '(?s)^(.*?)' || {lit(C.NAME_END)}, 1)) * CAST(regexp_matches(rest, {lit(C.NAME_END)}) AS INT)")
    s.add(TRADE_NAME="CASE WHEN n_ > 0 THEN trim(substring(rest, 1, n_)) ELSE '' END", rest="CASE WHEN n_ > 0 THEN trim(substring(rest, n_ + 1)) ELSE rest END")
    s.take("INVOICE_NO", C.IMAGE_INVOICE, when=f"{first('rest', C.IMAGE_INVOICE)} <> GSTIN").take("INVOICE_TYPE", C.TYPE, start=True).take("INVOICE_DATE", C.IMAGE_DATE)
    s.add(am_=image_amounts("rest"))
    for i, f in enumerate(("INVOICE_VALUE", "TAXABLE_VALUE", "IGST", "CGST", "SGST", "CESS")):
        s.add(**{f: f"coalesce(am_[{i + 1}], '')"})
    return s.add(PLACE_OF_SUPPLY=place("rest")).take("TAX_RATE", C.IMAGE_RATE, cut=False).take("REVERSE_CHARGE", r"\b([YN])\b", cut=False)


def register(ctes: str) -> str:
    s = Steps(ctes, f"SELECT doc_id, ord, trim(text) AS rest FROM li WHERE NOT {header('text')}")
    s.fields.append("rest")
    s.take("INVOICE_DATE", C.DATE, start=True).where("INVOICE_DATE <> ''").add(rest="regexp_replace(rest, '\\s+', ' ', 'g')").take("number_", r"(?:^|\s)(,*(?:\d,*){3,8})(?:\s|$)").where("number_ <> ''")
    s.split_at_id("rest").add(am_=f"[replace(a, ',', '') FOR a IN {every('after_', C.ITC_AMOUNT)}]", INVOICE_NO="replace(number_, ',', '')", TRADE_NAME="before_", SOURCE="'ITC Register'", PLACE_OF_SUPPLY=states("substring(GSTIN, 1, 2)", C.PDF_STATES))
    for i, f in enumerate(("TAXABLE_VALUE", "IGST", "CGST", "SGST", "CESS", "INVOICE_VALUE")):
        s.add(**{f: f"coalesce(am_[{i + 1}], '')"})
    return s.records(0.95, "direct_pdf_itc", "GSTIN <> ''")


def wide(ctes: str) -> str:
    """The wide row for lines that name their invoice with a prefix (the others are covered by unit tests)."""
    s = Steps(ctes, f"SELECT doc_id, ord, trim(text) AS text FROM li WHERE NOT {header('text')}").split_at_id("text").where("GSTIN <> ''")
    s.add(raw_=first("before_ || ' ' || after_", C.INVOICE), INVOICE_NO=clean_invoice("raw_"), inner_=first("raw_", C.DATE_ANYWHERE), TRADE_NAME="before_", rest="after_")
    s.take("INVOICE_TYPE", C.TYPE, cut=False).take("own_", C.DATE).add(INVOICE_DATE="CASE WHEN inner_ <> '' THEN inner_ ELSE own_ END", real_=real_amount("rest"))
    s.add(rest="CASE WHEN real_ <> '' THEN trim(substring(rest, instr(rest, real_) + length(real_))) ELSE rest END", INVOICE_VALUE="replace(real_, ',', '')")
    places = "((?i:" + "|".join(sorted(C.PDF_PLACES, key=len, reverse=True)) + "))"
    s.take("PLACE_OF_SUPPLY", places, default=states("substring(GSTIN, 1, 2)", C.PDF_STATES)).take("REVERSE_CHARGE", r"([NY])\s*", start=True).take("TAX_RATE", C.RATE, start=True)
    when = "TRUE"
    for f in ("TAXABLE_VALUE", "IGST", "CGST", "SGST", "CESS"):
        s.take(f, C.AMOUNT, start=True, when=when, default="''").add(**{f: f"replace({f}, ',', '')"})
        when = f"{f} <> ''"
    s.take("GSTR1_STATUS", r"([YN])\s+", start=True).take("GSTR1_FILING_DATE", C.MONTH_DATE, start=True).take("GSTR1_PERIOD", C.PERIOD, start=True).take("GSTR3B_STATUS", r"([YN])\s*", start=True)
    s.take("am_", r"([YN])\s+", start=True).add(AMENDMENT="CASE WHEN am_ <> '' THEN am_ ELSE 'N' END").take("TAX_PERIOD_AMENDED", C.PERIOD, start=True, when="am_ <> ''").take("CANCEL_DATE", C.DATE, start=True)
    s.take("SOURCE", C.SOURCE).take("irn_", C.IRN).add(IRN="CASE WHEN irn_ <> '' THEN irn_ ELSE 'N/A' END").take("IRN_DATE", C.DATE, when="irn_ <> ''")
    return s.records(0.97, "direct_pdf")


def line(ctes: str, source: str = "li") -> str:
    s = Steps(ctes, f"SELECT doc_id, ord, trim(text) AS text FROM {source} WHERE length(trim(text)) >= 15")
    s.fields.append("text")
    s.add(text=f"CASE WHEN {first('text', '^(?:' + C.ID + ')')} = '' THEN {drop('text', '^[0-9]{1,3} +')} ELSE text END", GSTIN=repair(first("text", "^(?:" + C.ID + ")"))).where(valid_id("GSTIN"))
    return after_id(s.add(rest=f"trim({drop('text', '^(?:' + C.ID + ')')})")).records(0.80, "ocr_image")


def anchored(ctes: str) -> str:
    s = Steps(ctes + ", cx AS (SELECT doc_id, ord, text, string_agg(trim(text), ' ') OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS context FROM li)", f"SELECT *, {repair(first('text', C.ID))} AS GSTIN FROM cx WHERE {first('text', C.ID)} <> ''")
    s.fields.append("GSTIN")
    return after_id(s.where(valid_id("GSTIN")).add(rest=f"trim({drop('context', '(?s)^.*?(?:' + C.ID + ')')})")).records(0.80, "ocr_image")


def generic(ctes: str) -> str:
    s = Steps(ctes, f"SELECT doc_id, ord, trim(text) AS rest FROM li WHERE length(trim(text)) >= 15 AND NOT {any_word('lower(text)', C.GENERIC_SKIP)}")
    s.fields.append("rest")
    s.add(am_=image_amounts("rest"), n_="len(am_)", id_=first("rest", C.ID), INVOICE_NO=first("rest", C.BILL_NO), INVOICE_DATE=first("rest", C.IMAGE_DATE)).where("n_ > 0 AND (INVOICE_DATE <> '' OR id_ <> '' OR INVOICE_NO <> '')")
    s.add(fixed_=repair("id_"), GSTIN=f"CASE WHEN {valid_id('fixed_')} THEN fixed_ ELSE '' END", TAXABLE_VALUE="CASE WHEN n_ >= 2 THEN am_[1] ELSE '' END", IGST="CASE WHEN n_ >= 3 THEN am_[2] ELSE '' END")
    s.add(CGST="CASE WHEN n_ >= 4 THEN am_[3] ELSE '' END", SGST="CASE WHEN n_ >= 4 THEN am_[4] ELSE '' END", INVOICE_VALUE="am_[n_]", PLACE_OF_SUPPLY=place("rest")).take("TAX_RATE", C.IMAGE_RATE, cut=False)
    return s.records(0.60, "generic_table", "GSTIN <> '' OR INVOICE_NO <> '' OR INVOICE_DATE <> ''")


def bill(ctes: str, alone: bool = False) -> str:
    """Bill lines (each rendered line has a bill number); alone: without a look at the lines about them."""
    low = "trim(lower(text))"
    w = "OVER (PARTITION BY doc_id ORDER BY ord)"
    near = "NULL AS prev_, NULL AS next_" if alone else f"lag(text) {w} AS prev_, lead(text) {w} AS next_"
    s = Steps(ctes, f"SELECT * FROM (SELECT doc_id, ord, trim(text) AS rest, {near} FROM li) q WHERE length(rest) >= 10 AND NOT ({any_word(low.replace('text', 'rest'), C.EWB_HEADERS)} AND length(rest) < 100)")
    s.fields.append("rest")
    s.take("INVOICE_NO", C.BILL_NO, cut=False).where("INVOICE_NO <> ''").take("INVOICE_DATE", C.IMAGE_DATE).add(am_=image_amounts("rest"), low_="lower(rest)")
    for i, f in enumerate(("TAXABLE_VALUE", "IGST", "CGST", "SGST")):
        s.add(**{f: f"coalesce(am_[{i + 1}], '')"})
    pick = lambda names, other: "CASE " + " ".join(f"WHEN contains(low_, '{n.lower()}') THEN '{n}'" for n in names) + f" ELSE '{other}' END"
    s.add(INVOICE_VALUE="CASE WHEN len(am_) >= 5 THEN am_[len(am_)] ELSE coalesce(am_[1], '') END", PLACE_OF_SUPPLY=place("rest"), INVOICE_TYPE=pick(C.TRANSPORT_MODES, "R"), GSTR1_STATUS=pick(C.BILL_STATUSES, ""))
    s.add(id_=repair(first("concat_ws(' ', prev_, rest, next_)", C.ID)), GSTIN=f"CASE WHEN {valid_id('id_')} THEN id_ ELSE '' END").take("TAX_RATE", C.IMAGE_RATE, cut=False)
    return s.records(0.75, "eway_bill", "INVOICE_VALUE <> ''")


def bill_ids(ctes: str) -> str:
    """Bill lines without a bill number, by their identifier."""
    low = "trim(lower(text))"
    s = Steps(ctes, f"SELECT doc_id, ord, trim(text) AS text FROM li WHERE length(trim(text)) >= 10 AND NOT ({any_word(low, C.EWB_HEADERS)} AND length(trim(text)) < 100) AND {first('text', C.BILL_NO)} = ''")
    s.add(GSTIN=repair(first("text", C.ID))).where(valid_id("GSTIN"))
    return after_id(s.add(rest=f"trim({drop('text', '(?s)^.*?(?:' + C.ID + ')')})")).records(0.80, "eway_bill_gstin")


#: Documents' texts.
TEXTS = "dt AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS text FROM li GROUP BY doc_id)"


def block_texts() -> str:
    """Blocks from each identifier of dt to the next, white space unified."""
    marked = f"regexp_replace(text, {lit(C.ID)}, chr(1) || '\\1', 'g')"
    cut = f"SELECT doc_id, unnest(string_split({marked}, chr(1))) AS b, unnest(range(1, 2 + length({marked}) - length(text))) AS k, CAST(regexp_matches(text, {lit('^(?:' + C.ID + ')')}) AS INT) AS at_start FROM dt"
    return f"SELECT doc_id, k - 1 - at_start AS ord, trim(regexp_replace(b, '\\s+', ' ', 'g')) AS text FROM ({cut}) q WHERE k > 1"


def block(ctes: str) -> str:
    s = Steps(ctes, block_texts())
    s.add(GSTIN=repair(first("text", "^(?:" + C.ID + ")"))).where(valid_id("GSTIN"))
    return after_id(s.add(rest=f"trim({drop('text', '(?s)^.*?(?:' + C.ID + ')')})")).records(0.80, "ocr_image")


def minimal(s: Steps) -> str:
    """A record of few fields from a context about a joined identifier."""
    s.add(GSTIN=repair(first("joined", C.ID_COLLAPSED))).where(valid_id("GSTIN"))
    s.add(am_=image_amounts("context"), inv_=first("context", C.IMAGE_INVOICE), INVOICE_DATE=first("context", C.IMAGE_DATE), INVOICE_VALUE="coalesce(am_[1], '')", TAXABLE_VALUE="coalesce(am_[2], '')")
    return s.add(INVOICE_NO="CASE WHEN inv_ <> GSTIN THEN inv_ ELSE '' END", PLACE_OF_SUPPLY=near_place("context")).records(0.70, "reconstructed_ocr")


def rebuilt(ctes: str, lines: bool = False) -> str:
    """Identifiers joined from runs of 2, 3 and 4 words (or lines), then from whole lines."""
    word = "SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY ord, p) - 1 AS at_ FROM (SELECT doc_id, ord, unnest(regexp_split_to_array(text, '\\s+')) AS t, unnest(range(1, 1 + len(regexp_split_to_array(text, '\\s+')))) AS p FROM li) x WHERE t <> ''"
    if lines:
        word = "SELECT doc_id, trim(text) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS at_ FROM li WHERE trim(text) <> ''"
    over = lambda n: f"OVER (PARTITION BY doc_id ORDER BY at_ ROWS BETWEEN {n} FOLLOWING)"
    sizes = " UNION ALL ".join(f"SELECT doc_id, {k} AS size, at_, string_agg(t, '') {over(f'CURRENT ROW AND {k - 1}')} AS run, string_agg(t, ' ') {over(f'2 PRECEDING AND {k + 7}')} AS context, count(*) {over(f'CURRENT ROW AND {k - 1}')} AS n FROM words" for k in (2, 3, 4))
    joined = f"SELECT doc_id, size * {1 << 40} + at_ AS ord, regexp_replace(upper(run), '[^A-Z0-9]', '', 'g') AS joined, context FROM ({sizes}) y WHERE n = size"
    whole = f"SELECT doc_id, 5 * {1 << 40} + ord AS ord, regexp_replace(text, '\\s+', '', 'g') AS joined, text AS context FROM li"
    return minimal(Steps(f"{ctes}, words AS ({word}), runs AS ({joined})", f"SELECT * FROM runs WHERE length(joined) >= 15 UNION ALL {whole}"))


def column_rows(ctes: str) -> str:
    """Rows of boxes: with an identifier as a line's rest, else as few fields about a torn one."""
    row = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS ord, regexp_replace(text, ' +', ' ', 'g') AS text FROM li"
    s = Steps(INNER, f"SELECT *, {repair(first('text', C.ID))} AS GSTIN FROM ({row}) q WHERE {first('text', C.ID)} <> ''")
    s.fields.append("GSTIN")
    strict = after_id(s.where(valid_id("GSTIN")).add(rest=f"trim({drop('text', '(?s)^.*?(?:' + C.ID + ')')})")).records(0.80, "ocr_image")
    torn = minimal(Steps(INNER, f"SELECT doc_id, ord, regexp_replace(text, '\\s+', '', 'g') AS joined, text AS context FROM ({row}) q WHERE {first('text', C.ID)} = ''"))
    return f"{ctes}, strict_rows AS ({strict}), torn_rows AS ({torn}) SELECT * FROM strict_rows UNION ALL SELECT * FROM torn_rows"


FORMAT = f"CASE WHEN {count_words('lower(text)', C.EWB_KEYWORDS)} >= 2 THEN 'eway_bill' WHEN {count_words('lower(text)', C.STATEMENT_KEYWORDS)} >= 2 THEN 'gst2a' WHEN len({every('text', C.BILL_NO)}) >= 3 THEN 'eway_bill' WHEN len({every('text', C.ID)}) >= 2 THEN 'gst2a' ELSE 'unknown' END"


#: Rows of boxes as lines, where the box texts are in lb.
ROWS = "WITH li AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS ord, regexp_replace(text, ' +', ' ', 'g') AS text FROM lb)"


def cascade(ctes: str, boxed: bool = False) -> str:
    """Common tables up to chosen (doc_id, strategy) and every (all strategies' records); boxed: with the texts of rows
    of boxes in lb, bills from them where that finds more, and strategy 5."""
    found = {"bills": f"SELECT * FROM ({bill(INNER)}) UNION ALL SELECT * FROM ({bill_ids(INNER)})", "lines": line(INNER), "blocks": block(INNER), "anchored": anchored(INNER), "rebuilt": rebuilt(INNER, boxed), "generic": generic(INNER)}
    parts, later = [ctes, TEXTS, f"fmt AS (SELECT doc_id, {FORMAT} AS fmt FROM dt)"], ["blocks", "anchored", "rebuilt", "generic"]
    if boxed:
        n = "SELECT doc_id, count(*) AS n FROM {0} GROUP BY doc_id"
        parts += [f"b_line AS MATERIALIZED ({found['bills']})", f"b_box AS MATERIALIZED ({bill(ROWS, alone=True)})"]
        parts.append(f"use_box AS (SELECT o.doc_id FROM ({n.format('b_box')}) o LEFT JOIN ({n.format('b_line')}) g USING (doc_id) WHERE coalesce(g.n, 0) < 3 AND o.n > coalesce(g.n, 0))")
        found["bills"] = "SELECT * FROM b_line WHERE doc_id NOT IN (SELECT doc_id FROM use_box) UNION ALL SELECT * FROM b_box WHERE doc_id IN (SELECT doc_id FROM use_box)"
        found["columns"] = column_rows("WITH li AS (SELECT * FROM lb)")
        later.insert(3, "columns")
    parts += [f"r_{k} AS MATERIALIZED ({v})" for k, v in found.items()]
    parts.append("every AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS strategy FROM r_{k}" for k in found) + ")")
    parts.append("counts AS (SELECT fmt.doc_id, fmt, " + ", ".join(f"count(*) FILTER (strategy = '{k}') AS n_{k}" for k in found) + " FROM fmt LEFT JOIN every USING (doc_id) GROUP BY fmt.doc_id, fmt)")
    parts.append("c0 AS (SELECT *, CASE WHEN fmt = 'eway_bill' THEN n_bills ELSE 0 END AS n, CASE WHEN fmt = 'eway_bill' AND n_bills > 0 THEN 'bills' ELSE '' END AS strategy FROM counts)")
    parts.append("c1 AS (SELECT * REPLACE (CASE WHEN (fmt = 'gst2a' OR n = 0) AND n_lines > 0 THEN n_lines ELSE n END AS n, CASE WHEN (fmt = 'gst2a' OR n = 0) AND n_lines > 0 THEN 'lines' ELSE strategy END AS strategy), n = 0 AS open_ FROM c0)")
    tried = "(fmt = 'gst2a' OR open_)"
    for k, name in enumerate(later, 2):
        better = f"{'TRUE' if name == 'generic' else tried} AND n < 3 AND n_{name} > n"
        parts.append(f"c{k} AS (SELECT * REPLACE (CASE WHEN {better} THEN n_{name} ELSE n END AS n, CASE WHEN {better} THEN '{name}' ELSE strategy END AS strategy) FROM c{k - 1})")
    return ", ".join([*parts, f"chosen AS (SELECT doc_id, strategy FROM c{len(later) + 1} WHERE strategy <> '')"])


def cascade_records(ctes: str, boxed: bool = False) -> str:
    """The chosen records, the first of each identifier and number, places filled from the state."""
    once = "row_number() OVER (PARTITION BY doc_id, GSTIN, INVOICE_NO, CASE WHEN GSTIN = '' AND INVOICE_NO = '' THEN ord END ORDER BY ord)"
    own = states("substring(GSTIN, 1, 2)", C.IMAGE_STATES)
    return f"{cascade(ctes, boxed)} SELECT * REPLACE (CASE WHEN PLACE_OF_SUPPLY = '' THEN {own} ELSE PLACE_OF_SUPPLY END AS PLACE_OF_SUPPLY) FROM every JOIN chosen USING (doc_id, strategy) QUALIFY {once} = 1"
