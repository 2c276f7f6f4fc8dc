"""Queries over rendered documents take every line of every document."""

import re

from pyspark.sql import functions as F

from slateledger.functions import constants as C
from slateledger.operators import cascade, parse
from slateledger.plans import render
from slateledger.plans.queries import QUERIES


def count(df):
    return dict(df.groupBy("doc_id").count().collect())


def choice(fmt, n):
    """What the cascade settles on, from the counts of each strategy over one document."""
    best, chosen = 0, ""
    if fmt == "eway_bill" and n["bills"] > 0:
        best, chosen = n["bills"], "bills"
    open_ = best == 0
    if (fmt == "gst2a" or open_) and n["lines"] > 0:
        best, chosen = n["lines"], "lines"
    for name in ("blocks", "anchored", "rebuilt"):
        if (fmt == "gst2a" or open_) and best < 3 and n[name] > best:
            best, chosen = n[name], name
    if best < 3 and n["generic"] > best:
        chosen = "generic"
    return chosen


def test_mixed_documents_are_whole(spark, sf):
    inv = render.invoices(spark, sf)
    got = count(render.mixed(inv))
    assert got == count(inv) and sum(got.values()) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert max(got.values()) > 100


def test_cascade_of_whole_documents(spark, sf):
    """Documents of all five kinds, each at full length: the choice, and records past the twelfth line."""
    li = render.mixed(render.invoices(spark, sf)).where("doc_id < 5")
    n = {k: count(getattr(parse, f"parse_{k}")(li)) for k in ("bills", "lines", "blocks", "anchored", "rebuilt", "generic")}
    want = {r.doc_id: choice(r.fmt, {k: v.get(r.doc_id, 0) for k, v in n.items()}) for r in cascade.document_formats(li).collect()}
    got = QUERIES["q_cascade"](spark, sf).where("doc_id < 5")
    assert dict(got.select("doc_id", "strategy").distinct().collect()) == {d: s for d, s in want.items() if s}
    assert len(set(want.values())) > 3
    assert got.where("doc_id = 0 and ord > 12").count() > 50


def test_token_windows_of_short_lists(spark):
    docs = spark.createDataFrame([(d, ["29ABCDE1234F1Z5"] * d) for d in range(4)], "doc_id long, tokens array<string>")
    got = sorted((r.doc_id, r["size"], r["at"]) for r in parse.token_windows(docs).collect())
    assert got == [(2, 2, 0), (3, 2, 0), (3, 2, 1), (3, 3, 0)]


def test_stream_order_takes_every_line(spark, sf):
    """Each line comes as two, as its characters round to two heights."""
    assert count(QUERIES["q_stream_order_text"](spark, sf)) == {d: 2 * n for d, n in count(render.invoices(spark, sf)).items()}


def test_bills_and_boxes_are_whole(spark, sf, monkeypatch):
    """Boxes win in two documents of three, where lines lost their numbers; no line is withheld."""
    seen = []
    real = parse.parse_bills
    monkeypatch.setattr(parse, "parse_bills", lambda li, boxes: seen.append(li) or real(li, boxes))
    got, inv = count(QUERIES["q_ewb_boxes"](spark, sf)), count(render.invoices(spark, sf))
    assert got == inv and count(seen[0]) == inv
    alone = count(real(seen[0]))
    assert {d: alone.get(d, 0) for d in inv} == {d: (0, 2, n)[d % 3] for d, n in inv.items()}


def rebuilt(texts):
    """The identifiers of parse_rebuilt, plainly."""
    tokens = [t for x in texts for t in re.split(r"\s+", x) if t]
    joined = [re.sub("[^A-Z0-9]", "", "".join(tokens[i : i + k]).upper()) for k in (2, 3, 4) for i in range(len(tokens) - k + 1)]
    joined = [j for j in joined if len(j) >= 15] + [re.sub(r"\s+", "", x) for x in texts]
    out = []
    for m in filter(None, (re.search(C.ID_COLLAPSED, j) for j in joined)):
        g = m.group(1)
        fix = lambda s, a, b: s.translate(str.maketrans(a, b))
        g = g[:2] + fix(g[2:7], "018", "OIB") + fix(g[7:11], "OISZ", "0152") + fix(g[11], "01", "OI") + g[12] + fix(g[13], "27", "ZZ") + g[14]
        if g[:2] in C.IMAGE_STATES and re.fullmatch(r".{2}[A-Za-z]{5}[0-9]{4}[A-Za-z].Z.", g):
            out.append(g)
    return sorted(out)


def test_reconstruction_of_all_documents_equals_brute_force(spark, sf):
    li, want = render.mixed(render.invoices(spark, sf)).where("doc_id < 5"), {}
    for r in li.orderBy("doc_id", "ord").collect():
        want.setdefault(r.doc_id, []).append(r.text)
    got = {d: [] for d in want}
    for r in QUERIES["q_parse_reconstruct"](spark, sf).where("doc_id < 5").select("doc_id", "GSTIN").collect():
        got[r.doc_id].append(r.GSTIN)
    assert {d: sorted(g) for d, g in got.items()} == {d: rebuilt(x) for d, x in want.items()}
    assert min(map(len, got.values())) > 0


def test_choice_runs_over_all_documents(spark, sf, monkeypatch):
    seen = []
    real = cascade.cascade
    monkeypatch.setattr(cascade, "cascade", lambda li: seen.append(li) or real(li))
    QUERIES["q_cascade_choice"](spark, sf)
    assert count(seen[0]) == count(render.invoices(spark, sf))


def test_token_windows_are_cut_from_short_arrays(spark):
    """A document of many tokens gives the windows of its plain list, across the stretches that it is cut into, and each
    token is collapsed in one place of the plan."""
    texts = [["29abcde", "1234F1Z5x", "", "a-b", "Zz99", "12,345.00"][k * k % 6] + str(k % 7) for k in range(300)]
    lists = {1: texts, 2: texts[:66], 3: texts[:65], 4: texts[:2]}
    docs = spark.createDataFrame(list(lists.items()), "doc_id long, tokens array<string>")
    got = parse.token_windows(docs)
    want = []
    for d, t in lists.items():
        for size in (2, 3, 4):
            for at in range(len(t) - size + 1):
                merged = re.sub("[^A-Z0-9]", "", "".join(t[at : at + size]).upper())
                if len(merged) >= 15:
                    want.append((d, size, at, merged, " ".join(t[max(0, at - 2) : at + size + 8])))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("[^A-Z0-9]") == 1


def test_steps_between_are_small(spark):
    """What is written between steps takes less than a tenth of a checkpoint where fields are mostly defaults."""
    from pathlib import Path

    from slateledger.operators.records import checkpointed

    df = spark.range(20_000).select("id", *[F.lit(C.DEFAULTS.get(f, "N/A")).alias(f) for f in C.FIELDS])
    got = checkpointed(df)
    files = [Path(f.removeprefix("file:")) for f in got.inputFiles()]
    assert got.count() == 20_000 and got.schema.names == df.schema.names
    assert 0 < sum(f.stat().st_size for f in files) < 20_000 * 8 * len(C.FIELDS) / 10


def plan(name, spark, sf):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_rows_of_boxes_stay_with_their_invoices(spark, sf):
    """Invoices are dealt by document once; words are gathered by document where they are."""
    assert plan("q_row_cluster", spark, sf).count(" Exchange ") == 1


def test_columns_are_scanned_where_the_invoices_are(spark, sf):
    assert plan("q_parse_colscan", spark, sf).count(" Exchange hashpartitioning") <= 2  # both kinds of rows, from one table each


def test_sides_are_read_from_invoices_numbered_once(spark, sf):
    p = plan("q_zip_groups", spark, sf)
    assert p.count("FileScan parquet") == 3 and "lineitem" not in p
