"""Main text, spelling variants and resampling against plain versions on small inputs."""

import hashlib
import html as entities
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from slateledger.llm import html, resample, spelling
from slateledger.llm.labelled_pages import labelled_pages
from slateledger.llm.queries import QUERIES

# ------------------------------------------------------------------ main text


@pytest.fixture(scope="module")
def field():
    return html.trained()


def test_labels_of_pages_not_learned_from(field):
    pages = [html.blocks(p) for p in labelled_pages(150, 77)]
    y = [html.labels(b) for b in pages]
    got = [field.decode(b) for b in pages]
    n = sum(map(len, y))
    assert n > 2500 and sum(a != b for p, q in zip(y, got, strict=True) for a, b in zip(p, q, strict=True)) <= 0.02 * n


def test_viterbi_is_the_best_labelling(field):
    r = np.random.default_rng(1)
    f = html.Field({"bias": 0})
    f.w, f.step, f.first, f.last = field.w, field.step, r.normal(size=2), r.normal(size=2)
    f.columns = field.columns
    for page in map(html.blocks, labelled_pages(40, 5)):
        page = page[:9]
        html.labels(page)
        s = f.scores(f.rows(page))
        of = lambda y: f.first[y[0]] + f.last[y[-1]] + sum(s[k, c] for k, c in enumerate(y)) + sum(f.step[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        assert f.decode(page) == list(max(itertools.product((0, 1), repeat=len(page)), key=of))


def test_fit_raises_the_likelihood():
    pages = [(b, html.labels(b)) for b in map(html.blocks, labelled_pages(12, 3))]

    def loss(f):
        total = 0
        for b, y in pages:
            s = f.scores(f.rows(b))
            alpha = s[0] + f.first
            for x in s[1:]:
                alpha = np.logaddexp.reduce(alpha[:, None] + f.step, axis=0) + x
            gold = f.first[y[0]] + f.last[y[-1]] + sum(s[k, c] for k, c in enumerate(y)) + sum(f.step[a, c] for a, c in itertools.pairwise(y))
            total += np.logaddexp.reduce(alpha + f.last) - gold
        return total

    few, many = loss(html.fit(pages, rounds=1)), loss(html.fit(pages))
    assert many < 0.1 * few and many > 0
    assert html.fit([]).decode(html.blocks("<p>a</p>")) == [0]


SOURCES = {
    "<p>a <b>b</b>c&amp;d<br>e &nbsp;\n f<p>g": ["a bc&d e f", "g"],
    "x<!-- <p>no</p> -->y<script>'</p>'; \"<p>z\"</script>z": ["xyz"],
    "<ul><li>a<li>b</ul>c": ["a", "b", "c"], "1 < 2 <3>4": ["1 < 2 <3>4"], "<a title='>'>t</a><p class=\"": ["t"],
    "<td>a<td>b</table></p>": ["a", "b"], "<style>p{}": [], "&lt;p&gt;&copy&#233;": ["<p>©é"], "": [], "<svg><text>no</text></svg>ok</div>": ["ok"],
}


@pytest.mark.parametrize("source", list(SOURCES))
def test_leaf_blocks(source):
    assert [b.text for b in html.blocks(source)] == SOURCES[source]


def article(source):
    """What the given pages have between article tags, block by block."""
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    return " ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", inner))).split())


def test_query_on_given_pages(spark, sf):
    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op11_html"](spark, sf).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(want)


def test_odd_pages(spark, field):
    long = "<article>" + "<p>One sentence of some words, and so on.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<div>" * 5000 + "x", "t"), (4, "u", long, "t"), (4, "u", long, "t"), (5, "u", "<nav><a href=/>Home</a></nav>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df, field).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got if r.page_id) == [(1, 0), (2, 0), (4, 20_000 * 39 - 1), (4, 20_000 * 39 - 1), (5, 0)] and len(got) == 6
    assert html.extract(df.limit(0), field).count() == 0


# ------------------------------------------------------------------ spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(counts, times):
    out = {}
    for w, n in counts.items():
        own = [(-counts[x], x) for x in counts if near(w, x)]
        best = min(own, default=None)
        out[w] = (len(own), best[1], -best[0]) if best and -best[0] >= times * n else (len(own), None, None)
    return out


@pytest.mark.parametrize(("hot", "small"), [(4096, 24), (3, 1), (40, 3)])
def test_variants(spark, hot, small):
    r = random.Random(hot)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 7))) for _ in range(400)} | {"", "日本", "日本語", "日木語", "z" * 5000, "z" * 4999 + "y", "z" * 4998}
    counts = {w: r.choice((1, 1, 2, 9, 10, 40, 400)) for w in sorted(words)}
    counts["".join("a")] = 10_000
    got = spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), hot=hot, small=small).collect()
    want = variants(counts, 10)

    def root(w):
        while want[w][1] is not None:
            w = want[w][1]
        return w

    assert {x.word: (x.n_near, x.form, x.form_n) for x in got} == want and all(x.root == root(x.word) and x.n == counts[x.word] for x in got) and len(got) == len(counts)


def test_typed_words(spark):
    """Letters go by the crc32 of id and word; words of seven letters and more that are left count."""
    r = random.Random(2)
    docs = [(d, " ".join(r.choice(["Straßen", "ABCDEFG", "abcdefgh", "naïveté", "×÷letters", "short"]) for _ in range(60)) + "\x00été9abcdefgh日") for d in range(40)] + [(None, "abcdefgh"), (50, None), (51, ""), (7, "abcdefgh")]
    want = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            w = w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += len(w) >= 7
    got = spelling.typed_words(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, word string")).groupBy("word").count().collect()
    assert {x.word: x["count"] for x in got} == {w: n for w, n in want.items() if n}


def test_no_words(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_variants(empty).collect() == []


# ------------------------------------------------------------------ resampling


def drawn(docs, target, percent, least, order, buckets):
    """(n_features, weight, score) by row and the rows drawn, in order."""
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    def grams(t):
        w = fold(t)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, order + 1) for k in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in grams(x)), Counter(b for x in target for b in grams(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for d, x in docs:
        own = [gain[b] for b in grams(x)]
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(own) // len(own) if own else 0
        out.append((d, len(own), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted(((-out[k][3], math.inf if d is None else d) for k, (d, x) in enumerate(docs) if len(fold(x)) >= least))
    return out, fit[: percent * len(fit) // 100]


@pytest.mark.parametrize(("order", "percent", "stream"), [(1, 10, 4 << 20), (3, 55, 100)])
def test_resampling(spark, monkeypatch, order, percent, stream):
    monkeypatch.setattr(resample, "STREAM_BYTES", stream)
    monkeypatch.setattr(resample, "RANK_BYTES", 500)
    r = random.Random(order)
    word = lambda: r.choice(["Öl", "THE", "the", "a1", "b-c", "日本", "x", "y", "z"])
    docs = [(d, " ".join(word() for _ in range(r.randint(0, 60)))) for d in range(300)] + [(7, "the " * 30)] * 90 + [(None, "x " * 25), (400, None), (401, ""), (402, "!?"), (403, "Öl " * 20_000)]
    target = ["the x THE", None, "", "日本 öl"]
    want, best = drawn(docs, target, percent, 20, order, 500)
    df = spark.createDataFrame([(d, t, 1, 2.0) for d, t in docs], "doc_id long, text string, rank int, score double")
    got = resample.importance_resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, order, 500).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((x.doc_id, x.n_features, x.weight, x.score) for x in got), key=key) == sorted(want, key=key)
    ranked = sorted((x for x in got if x["rank"] is not None), key=lambda x: x["rank"])
    assert [x["rank"] for x in ranked] == list(range(1, len(best) + 1)) and [(-x.score, math.inf if x.doc_id is None else x.doc_id) for x in ranked] == best
    empty = df.limit(0)
    assert resample.importance_resample(empty, empty.select("text")).count() == 0
