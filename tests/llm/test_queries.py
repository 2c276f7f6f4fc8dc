"""The registered queries against plain versions, on the 200 smallest documents and some odd ones."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from slateledger.llm import common, langid, packing, pii, quality, toxicity
from slateledger.llm.queries import ORACLE, QUERIES
from tests.llm import brute

ODD = [
    (900_001, None, "en"), (900_002, "", "de"), (900_003, "12 !?", None), (900_004, "mail john (at) mail [dot] example (dot) com, a@b.co", "en"),
    (900_005, "call +44 20 7946 09 five eight one or 10.0.0.7 and 4111 1111 1111 1111", "en"), (900_006, "ruf plus vier neun eins zwei drei vier fünf sechs sieben acht", "de"),
    (900_007, "to jоhn@example.com é", "fr"), (900_008, "word " * 3000, "en"),
]


@pytest.fixture(scope="module")
def here(spark, sf, tmp_path_factory):
    """A folder with the documents and odd ones, and the other tables as they are."""
    to = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(d, t, lang, "odd", len(t or "")) for d, t, lang in ODD], docs.schema)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text.split()
    moved = [(900_100 + k, " ".join([*item[:5], item[6], item[5], *item[7:11], *["extra"] * k, *item[11:30]]), "en", "odd", 1) for k in range(4)]
    odd = odd.unionByName(spark.createDataFrame(moved, docs.schema))
    docs.unionByName(odd).write.parquet(f"{to}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{to}/{t}.parquet")
    return str(to)


@pytest.fixture(scope="module")
def text(spark, here):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{here}/documents.parquet").collect()}


def result(spark, here, name):
    rows = QUERIES[name](spark, here).collect()
    return {r.doc_id: r for r in rows}, rows


def held_out(d, mod, rest):
    return zlib.crc32(str(d).encode()) % mod == rest


def test_toxicity(spark, here, text):
    """Every tree walked for one text at a time, the calibration interpolated by hand."""
    got, rows = result(spark, here, "op3_toxicity")
    model = toxicity.fit(common.table(spark, here, "documents"), common.table(spark, here, "labels"))
    t, c = model.trees, model.calibrate
    for d, x in text.items():
        f, margin = toxicity.features((x or "").encode(), model.lexicon), t.base
        for (feature, cut), leaf in zip(t.splits, t.leaves, strict=True):
            node = 0
            for level in range(t.depth):
                k, at = int(feature[level][node]), int(cut[level][node])
                node = 2 * node + (sum(e <= f[k] for e in t.edges[k]) > at)
            margin += leaf[node]
        k = sum(a <= margin for a in c.at) - 1
        if 0 <= k < len(c.at) - 1:
            score = c.value[k] + (c.value[k + 1] - c.value[k]) * (margin - c.at[k]) / (c.at[k + 1] - c.at[k])
        else:
            score = c.value[max(k, 0)]
        score = min(1, max(0, score + 1e-6 * math.tanh(margin / 10)))
        assert got[d].held_out == held_out(d, 5, 0) and abs(got[d].score - score) < 1e-9 and got[d].predicted == (got[d].score >= 0.5)
    assert len(rows) == len(text)


def test_language(spark, here, text):
    """Counts of n-grams in dictionaries, one product of probabilities a text."""
    got, rows = result(spark, here, "op6_language_id")

    def grams(t):
        s = "\n" + t.lower() + "\n"
        for n in langid.ORDERS:
            for i in range(len(s) - n + 1):
                h = n
                for c in s[i : i + n]:
                    h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
                    h ^= h >> 15
                yield h % langid.BUCKETS

    learned = {r.doc_id: r.lang for r in common.table(spark, here, "documents").collect() if r.text is not None and r.lang is not None and not held_out(r.doc_id, 5, 0)}
    langs = sorted(set(learned.values()))
    counts, texts = {k: {} for k in langs}, {k: 0 for k in langs}
    for d, k in learned.items():
        texts[k] += 1
        for g in grams(text[d]):
            counts[k][g] = counts[k].get(g, 0) + 1
    total = {k: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for k, c in counts.items()}
    every = sum(n + 1 for n in texts.values())
    for d, t in text.items():
        r = got[d]
        assert r.held_out == held_out(d, 5, 0)
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        own = list(grams(t))
        s = [math.log((texts[k] + 1) / every) + sum(math.log((counts[k].get(g, 0) + langid.SMOOTHING) / total[k]) for g in own) for k in langs]
        e = [math.exp((x - max(s)) / math.sqrt(len(t) + 2)) for x in s]
        assert r.lang_pred == langs[s.index(max(s))] and abs(r.score - max(e) / sum(e)) < 1e-3
    assert len(rows) == len(text)


def test_quality(spark, here, text):
    """One passage at a time through the attention."""
    got, rows = result(spark, here, "op7_quality")
    m = quality.fit(common.table(spark, here, "documents"), common.table(spark, here, "labels"))
    p, sig = m.p, lambda x: 1 / (1 + np.exp(-x))
    for d, t in text.items():
        data = (t or "").encode()
        passages = [data[k : k + quality.PASSAGE] for k in range(0, max(1, len(data)), quality.PASSAGE)]
        h = [np.tanh(((quality.encode([x])[0][0] - m.mean) / m.scale) @ p["W"] + p["b"]) for x in passages]
        a = np.array([((np.tanh(x @ p["V"]) * sig(x @ p["U"])) @ p["w"])[0] for x in h])
        w = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
        score = float(sig(sum(k * x for k, x in zip(w, h, strict=True)) @ p["o"] + p["c"])[0])
        assert got[d].held_out == held_out(d, 3, 1) and abs(got[d].score - score) < 1e-6 and got[d].predicted == (got[d].score >= 0.5)
    assert len(rows) == len(text)


def test_near_copies(spark, here, text):
    got, rows = result(spark, here, "op8_simhash")
    prints = {d: brute.fingerprint(t) for d, t in text.items()}
    want = brute.components(prints)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{prints[d]:016x}", want[d]) for d in prints} and len(rows) == len(text)


def test_packing(spark, here, text):
    """Every id of the tokenizer's library in one piece; every window full, or a power of two."""
    _, rows = result(spark, here, "op9_packing")
    lib, left, windows = packing.Encoder(packing.vocabulary()).lib, dict(text), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        if r.start == 0:
            ids, at = np.array(lib.encode(left.pop(r.doc_id) or "", add_special_tokens=False).ids + [0], "<u4"), 0
        assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
        at += r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not left
    for w in windows.values():
        ends = [a + n for a, n in sorted(w)]
        assert [a for a, _ in sorted(w)] == [0, *ends[:-1]] and (ends[-1] == 1024 or ends[-1] < 1024 and ends[-1].bit_count() == 1)
    assert sum(max(a + n for a, n in w) < 1024 for w in windows.values()) <= 10 * 64


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def usual(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def test_pii(spark, here, text):
    """Counts, base digest and spans from the plain patterns, and the added spans one by one."""
    got, rows = result(spark, here, "op10_pii")
    kinds = list(PATTERNS)
    for d, t in text.items():
        base = [(k, m.start(), m.end()) for k in kinds for m in re.finditer(PATTERNS[k], t or "") if usual(k, m.group())]
        every = sorted([*base, *pii.find(t)[1]], key=lambda s: (kinds.index(s[0]), s[1]))
        show = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
        r = got[d]
        assert r.base_sha256 == hashlib.sha256(show(base).encode()).hexdigest() and r.spans == show(every)
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in every) for k in kinds] and (r.n_spans, r.n_added) == (len(every), len(every) - len(base))
    assert len(rows) == len(text) and got[900_004].spans == "email:5:43,email:45:51" and got[900_005].n_added == got[900_006].n_phone == got[900_007].n_added == 1


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, here, name):
    """The SQL for the driver, on tables with odd and moved texts."""
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{here}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, here)
    cols = sorted(df.columns)
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    if name == "op5_decontam":
        assert any(r[cols.index("n_near")] for r in got)


DISGUISES = {
    "en": (" at ", " dot ", "zero one two three four five six seven eight nine".split(), "plus"), "fr": (" arobase ", " point ", "zéro un deux trois quatre cinq six sept huit neuf".split(), "plus"),
    "de": (" ät ", " punkt ", "null eins zwei drei vier fünf sechs sieben acht neun".split(), "plus"), "es": (" arroba ", " punto ", "cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "más"),
}


@pytest.mark.parametrize("lang", sorted(DISGUISES))
def test_recall_of_disguised_identifiers(spark, sf, lang):
    """Disguised data put between words of real documents of each language; nine of ten are found exactly."""
    at, dot, digits, plus = DISGUISES[lang]
    docs = [r.text.split() for r in spark.read.parquet(f"{sf}/documents.parquet").where(f"lang = '{lang}' and n_chars > 200").limit(20).collect()]
    r, found, n = np.random.default_rng(5), 0, 0
    say = lambda s: " ".join(digits[int(c)] for c in s)
    for words in docs:
        number = "".join(map(str, r.integers(1, 9, 10)))
        forms = [
            ("email", f"anna.k{at}example{dot}com"), ("email", f"anna.k ({at.strip()}) example [{dot.strip()}] com"), ("email", "аnna.k@exаmple.com"), ("email", "ａｎｎａ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
            ("phone", f"+49 {number[:4]} {say(number[4:7])} {number[7:]}"), ("phone", f"{plus} {say('49' + number)}"), ("ip", "192[.]168[.]1[.]10"), ("card", say("4111111111111111")), ("email", "an​na@exam­ple.com"),
        ]
        for kind, form in forms:
            k = int(r.integers(1, len(words)))
            front = " ".join(words[:k]) + " : "
            text = f"{front}{form} ; {' '.join(words[k:])}"
            n += 1
            found += (kind, len(front), len(front) + len(form)) in [s for x in pii.find(text) for s in x]
    assert n >= 90 and found / n >= 0.9, (found, n)


def test_toxic_features(text):
    """Every feature counted plainly, and one text by hand: two insults (one near `you`), one disguised."""
    lex = toxicity.Lexicon(learned={b"word": 1.5, b"das": 0.5})
    plain = lambda x: {w.decode("latin-1") for w in x}
    own = "IDIOT! you st0pid? a b c d e f moron, m o r o n"
    cases = [own, "YOU ARE sc.um TRASH", "1d10t iidiiot 1-2 tu es un crétin", "é" * 50, "!!!", *text.values()]
    for t in cases:
        want = brute.toxic_features(t, plain(lex.fixed), {"word": 1.5, "das": 0.5}, plain(lex.second))
        assert np.allclose(toxicity.features((t or "").encode(), lex), want, atol=1e-12), (t or "")[:80]
    by_hand = dict(zip(toxicity.FEATURES, toxicity.features(own.encode(), lex), strict=True))
    # words: idiot you st pid a b c d e f moron m o r o n
    assert by_hand["fixed_hits"] == np.log1p(2) and by_hand["fixed_kinds"] == 2 and by_hand["near_second"] == 0.5 and by_hand["second_density"] == 1000 / 16
    assert by_hand["caps_words"] == by_hand["exclaims"] == by_hand["questions"] == 1 / 16 and by_hand["capitals"] == 5 / 29
