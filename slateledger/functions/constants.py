"""Fixed values of the statement and bill formats: names, codes, keywords, grammars.

Everything in this module is data that results depend on; it is stated as it has to be.
"""

# The record fields, in export order, and which of them are numeric.
FIELDS = [
    "GSTIN", "TRADE_NAME", "INVOICE_NO", "INVOICE_TYPE", "INVOICE_DATE", "INVOICE_VALUE", "PLACE_OF_SUPPLY", "REVERSE_CHARGE", "TAX_RATE",
    "TAXABLE_VALUE", "IGST", "CGST", "SGST", "CESS", "GSTR1_STATUS", "GSTR1_FILING_DATE", "GSTR1_PERIOD", "GSTR3B_STATUS",
    "AMENDMENT", "TAX_PERIOD_AMENDED", "CANCEL_DATE", "SOURCE", "IRN", "IRN_DATE",
]
NUMERIC = ["INVOICE_VALUE", "TAX_RATE", "TAXABLE_VALUE", "IGST", "CGST", "SGST", "CESS"]
AMOUNTS = ["INVOICE_VALUE", "TAXABLE_VALUE", "IGST", "CGST", "SGST", "CESS"]

# The fields' names on a sheet.
TITLES = [
    "GSTIN of Supplier", "Trade / Legal Name", "Invoice Number", "Invoice Type", "Invoice Date", "Invoice Value (₹)", "Place of Supply", "Reverse Charge", "Tax Rate (%)",
    "Taxable Value (₹)", "IGST (₹)", "CGST (₹)", "SGST / UTGST (₹)", "CESS (₹)", "GSTR-1 Filing Status", "GSTR-1 Filing Date", "GSTR-1 Period", "GSTR-3B Filing Status",
    "Amendment", "Tax Period Amended", "Cancellation Date", "Source", "IRN", "IRN Date",
]

# Defaults of fields that are not blank.
DEFAULTS = {"INVOICE_TYPE": "R", "REVERSE_CHARGE": "N", "AMENDMENT": "N", "TAX_PERIOD_AMENDED": "N/A", "CANCEL_DATE": "N/A", "SOURCE": "Unknown", "IRN": "N/A", "IRN_DATE": "N/A"}

# State codes of digital statements; images know 26 as well.
PDF_STATES = {
    "01": "Jammu and Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh", "05": "Uttarakhand", "06": "Haryana",
    "07": "Delhi", "08": "Rajasthan", "09": "Uttar Pradesh", "10": "Bihar", "11": "Sikkim", "12": "Arunachal Pradesh",
    "13": "Nagaland", "14": "Manipur", "15": "Mizoram", "16": "Tripura", "17": "Meghalaya", "18": "Assam", "19": "West Bengal",
    "20": "Jharkhand", "21": "Odisha", "22": "Chhattisgarh", "23": "Madhya Pradesh", "24": "Gujarat", "27": "Maharashtra",
    "28": "Andhra Pradesh", "29": "Karnataka", "30": "Goa", "31": "Lakshadweep", "32": "Kerala", "33": "Tamil Nadu",
    "34": "Puducherry", "35": "Andaman", "36": "Telangana", "37": "Andhra Pradesh", "38": "Ladakh",
}
IMAGE_STATES = dict(sorted({**PDF_STATES, "26": "Dadra Nagar Haveli"}.items()))

# Place names as digital statements write them.
PDF_PLACES = [
    "Tamil Nadu", "Andhra Pradesh", "Arunachal Pradesh", "Himachal Pradesh", "Jammu and Kashmir", "Madhya Pradesh", "Uttar Pradesh", "West Bengal",
    "Karnataka", "Maharashtra", "Rajasthan", "Uttarakhand", "Chhattisgarh", "Jharkhand", "Kerala", "Gujarat", "Haryana", "Punjab", "Bihar", "Odisha",
    "Assam", "Telangana", "Goa", "Tripura", "Meghalaya", "Manipur", "Mizoram", "Nagaland", "Sikkim", "Puducherry", "Chandigarh", "Lakshadweep",
    "Andaman", "Ladakh", "Delhi",
]

# Keywords of headers and formats.
HEADER_KEYWORDS = [
    "gstin of supplier", "trade name", "invoice number", "invoice no", "invoice date", "invoice value", "place of supply", "reverse charge", "tax rate",
    "taxable value", "integrated tax", "central tax", "state/ut tax", "cess", "gstr-1", "gstr1", "filing status", "amendment", "irn", "sl.no", "sr.no",
    "s.no", "sl no", "total", "grand total", "sub total",
]
HEADER_LINE = r"^(?:total|grand total|sub total|page\s+\d+|sl\.?\s*no\.?)$"
EWB_HEADERS = ["e-way bill", "eway bill", "ewb number", "consign", "transport mode", "logistics", "tax & value", "fy 20", "gst e-way", "bill register", "total", "grand total", "page "]
GENERIC_SKIP = ["total", "grand total", "page ", "sl.no", "sr.no", "invoice number", "gstin of", "ewb number", "bill register", "fy 20"]
EWB_KEYWORDS = ["e-way bill", "eway bill", "ewb number", "ewb no", "consignor", "consignee", "transport mode", "vehicle no", "from state", "to state", "e way bill register", "eway bill register"]
STATEMENT_KEYWORDS = ["gst 2a", "gstr-2a", "gstr2a", "gstin of supplier", "invoice details", "invoice number", "invoice value", "taxable value", "integrated tax", "central tax", "place of supply", "reverse charge"]
GROUP_A_MARKERS = ["gstn", "gstin", "invoice number", "invoice no", "invoice date"]
GROUP_B_MARKERS = ["taxable value", "integrated tax", "central tax", "state/ut tax", "gstr-1", "gstr1", "filing status", "filing date"]
GROUP_C_MARKERS = ["amendment", "irn", "irn date", "source", "e-invoice", "cancellation"]
ITC_MARKERS = ["itc purchase register", "purchase register", "supplier details", "taxable tax breakdown", "total transaction value"]
TRANSPORT_MODES = ["Road", "Rail", "Air", "Ship"]
BILL_STATUSES = ["Active", "Cancelled", "Delivered", "Expired"]

# Grammars.
ID = r"\b(\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d])\b"
ID_RELAXED = r"(\d{2}[A-Z0-9]{10,13})"
ID_COLLAPSED = r"(\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d])"
BILL_NO = r"\b(\d{12})\b"
DATE = r"\b(\d{2}[-/]\d{2}[-/]\d{4})\b"
DATE_ANYWHERE = r"(\d{2}[-/]\d{2}[-/]\d{4})"
IMAGE_DATE = r"\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b"
MONTH_DATE = r"\b(\d{2}[-/][A-Za-z]{3}[-/]\d{2,4})\b"
PERIOD = r"\b([A-Za-z]{3}[-/]\d{2,4})\b"
AMOUNT = r"(\d+\.\d{1,2}|\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?|\d+)"
IMAGE_AMOUNT = r"\b(\d{1,3}(?:[,]\d{2,3})*(?:\.\d{1,2})?)\b"
PLAIN_AMOUNT = r"\b(\d+\.\d{1,2}|\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?)\b"
ITC_AMOUNT = r"([\d,]+\.\d{2})"
RATE = r"\b(0|5|12|18|28)\b"
IMAGE_RATE = r"\b(0|5|12|18|28)(?:\s*%|\b)"
TYPE = r"\b(R|DE|SEWP|SEZWP|SEZWOP|CBW|RE)\b"
SOURCE = r"\b((?i:E-Invoice|GSTR-1A|GSTR-1|GSTR-5|IFF|Manual))\b"
INVOICE = r"((?i:INV[-/][A-Z0-9-]+))"
IMAGE_INVOICE = r"\b([A-Z0-9][-A-Z0-9/_]{2,25})\b"
IRN = r"\b((?i:[0-9a-f]{64}))\b"
NAME_END = r"(?:\d{2}[-/.]\d{2}[-/.]|\b\d{3,}\b|INV[-/]|\bR\b)"

# Confidences by strategy.
CONFIDENCE = {"itc": 0.95, "split": 0.98, "wide": 0.97, "line": 0.80, "rebuilt": 0.70, "bill": 0.75, "generic": 0.60, "emergency": 0.30}
