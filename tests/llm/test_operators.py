import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from slateledger.llm import common, components, decontam, exact, induced, langid, packing, pii, quality, simhash, substring, suffix, toxicity
from tests.llm import brute

EXTRA = "lang string, source string, n_chars long, part int, bid long, fp long, sha string, node long, score double, keys binary, gone_id long, _hit string"


def frame(spark, docs):
    """Documents with further columns whose names the operators use themselves."""
    rows = [(d, t, "en", "src", 1, 2, 3, 4, "s", 5, 0.5, b"k", 6, "h") for d, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, " + EXTRA)


def passage_docs(seed, n=60, vocabulary=40):
    """Texts that share passages of all lengths, with copies, blanks and a long one."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") * r.randint(1, 3) + str(r.randint(0, vocabulary))
    pool = [[word() for _ in range(r.randint(5, 90))] for _ in range(12)]
    docs = []
    for d in range(n):
        parts = [r.choice(pool) if r.random() < 0.5 else [word() for _ in range(r.randint(0, 40))] for _ in range(r.randint(0, 4))]
        docs.append((d, r.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, docs[0][1]), (n + 4, "é " * 300), (n + 5, " ".join(word() for _ in range(30_000)))]
    return docs


@pytest.fixture(scope="module")
def docs():
    return passage_docs(1)


EMPTY = []


def test_sliding_minimum():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 28):
        x = r.integers(0, 9, 60).astype(np.uint64)
        assert suffix.sliding_min(x, n).tolist() == [min(x[i : i + n]) for i in range(60 - n + 1)]


def rows_of(cols):
    return [dict(zip(cols, x, strict=True)) for x in zip(*cols.values(), strict=True)]


@pytest.mark.parametrize("bits", [4, 25])
def test_sketches_merge_and_never_underestimate(monkeypatch, bits):
    """What batches send are cells of the table; merged in any order, every repeated window is told."""
    monkeypatch.setattr(substring, "SLICE_BITS", bits)
    monkeypatch.setattr(substring.Sketch.__init__, "__defaults__", (bits,))
    monkeypatch.setattr(substring.Counters.__init__, "__defaults__", (bits,))
    r = np.random.default_rng(5)
    batches, parts = [r.integers(0, 3000, n).astype(np.uint64) for n in (0, 1, 700, 900)], 3
    sketches = [substring.Sketch(common.mix(b), parts) for b in batches]
    sent = [x for k, s in enumerate(sketches) for x in rows_of(s.rows(k))]
    assert not {"keys", "windows"} & set(sent[0])
    told = {}
    for p in range(parts):
        for got in substring.add_sketches(parts)(iter([pa.RecordBatch.from_pylist([x for x in sent if x["part"] == p][::-1])] if sent else [])):
            for bid, part, data in zip(got["bid"], got["part"], got["bits"], strict=True):
                told.setdefault(bid, []).append((part, data))
    count = Counter(np.concatenate(batches).tolist())
    wrong = 0
    for k, (b, s) in enumerate(zip(batches, sketches, strict=True)):
        yes = s.repeated([p for p, _ in told.get(k, [])], [d for _, d in told.get(k, [])])
        want = np.array([count[x] > 1 for x in b.tolist()], bool)
        assert (yes | ~want).all()
        wrong += (yes & ~want).sum()
    assert bits == 4 or wrong == 0


def test_counters_stay_at_their_most():
    c = substring.Counters(3)
    cells = np.ascontiguousarray(np.array([2], np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()
    for _ in range(300):
        c.add(cells, b"\x01")
    assert c.n.tolist() == [0, 0, 255, 0, 0, 0, 0, 0]


@pytest.mark.parametrize("window", [35, 6, 3, 1])
def test_passages_equal_brute_force(spark, docs, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.repeated_passages(frame(spark, docs), window=window).collect()}
    assert got == brute.passages(docs, window)


@pytest.mark.parametrize("window,gram,lot,hot", [(400, 24, 1 << 20, 4096), (40, 8, 1 << 20, 4096), (40, 8, 300, 5), (9, 4, 1, 3), (9, 4, 1 << 20, 1)])
def test_bytes_equal_brute_force(spark, docs, window, gram, lot, hot):
    some = [d for d in docs if len(d[1] or "") < 20_000]
    rows = suffix.repeated_bytes(frame(spark, some), window=window, gram=gram, sort_bytes=lot, hot=hot).collect()
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in rows}
    assert got == brute.byte_strings(some, window)


def thue_morse(bits):
    x = "0"
    while len(x) < 1 << bits:
        x += x.translate({48: "1", 49: "0"})
    return x


@pytest.mark.parametrize("hot", [4096, 1])
def test_strings_of_equal_polynomial_hash_are_told_apart(spark, hot):
    """Two documents whose strings have one polynomial hash modulo 2 ** 64 and share no 400 bytes."""
    r, x = random.Random(1), thue_morse(8)
    front, back = ("".join(r.choice("abcdefgh") for _ in range(n)) for n in (100, 324))
    some = [(1, front + x + back), (2, front + x.translate({48: "1", 49: "0"}) + back), (3, front + x[:-1] + "2" + back)]
    got = {d.doc_id: sum(s.end - s.start for s in d.spans) for d in suffix.repeated_bytes(frame(spark, some), hot=hot).collect()}
    assert got == {d: v[1] for d, v in brute.byte_strings(some, 400).items()} == {1: 0, 2: 0, 3: 0}
    words = [(d, " ".join(t)) for d, t in some]
    got = {d.doc_id: d.n_removed for d in substring.repeated_passages(frame(spark, words), window=256).collect()}
    assert got == {d: v[1] for d, v in brute.passages(words, 256).items()}


def test_a_shard_larger_than_its_memory_spills(spark, monkeypatch):
    """The query's own bounds: strings are in a file of the task, a lot's queues go to disk."""
    files, put = [], induced.Spool.put

    def counting(self, *arrays):
        got = put(self, *arrays)
        files.append(self.file is not None)
        return got

    monkeypatch.setattr(induced.Spool, "put", counting)
    r = random.Random(4)
    shared = "".join(r.choice("abcdefgh ") for _ in range(500))
    texts_ = [("".join(r.choice("abcdefgh ") for _ in range(200)) + shared + "".join(r.choice("abcdefgh ") for _ in range(200))).encode() for _ in range(3 * induced.IN_MEMORY // 6 // 900)]
    shard = suffix.Shard(suffix.WINDOW, suffix.SORT_BYTES)
    z = zstandard.ZstdCompressor(1)
    spans = np.array([len(t) - suffix.WINDOW + 1 for t in texts_], np.uint32)
    tags = np.array([np.frombuffer(hashlib.sha256(t).digest()[:16], np.uint64) for t in texts_])
    keys = np.zeros(len(texts_), np.uint64)
    n = shard.add({"keys": keys.tobytes(), "tags": tags.tobytes(), "spans": spans.tobytes(), "counts": np.ones(len(texts_), np.uint32).tobytes(), "body": z.compress(b"".join(texts_))}, zstandard.ZstdDecompressor())
    near = [[hash(t[i : i + 400]) for i in range(185, 316)] for t in texts_]  # windows beyond share nothing
    count = Counter(x for row in near for x in row)
    for got, row in zip(shard.solve(), near, strict=True):
        assert np.flatnonzero(np.unpackbits(np.frombuffer(got, np.uint8), bitorder="little")).tolist() == [185 + i for i, x in enumerate(row) if count[x] > 1]
    assert n == len(texts_)
    assert any(files) and shard.size > induced.IN_MEMORY // 6


@pytest.mark.parametrize("in_memory", [0, 1 << 20])
def test_induced_suffix_and_prefix_arrays(monkeypatch, in_memory):
    monkeypatch.setattr(induced, "IN_MEMORY", in_memory)
    monkeypatch.setattr(induced, "TAKE", 3)
    read, get = [], induced.Spool.get
    monkeypatch.setattr(induced.Spool, "get", lambda self, token: read.append(not isinstance(token[0], np.ndarray)) or get(self, token))
    r = np.random.default_rng(2)
    for k in range(300):
        monkeypatch.setattr(induced, "MOST_BUCKETS", 600 if k % 2 else 0)
        t = r.integers(1, r.integers(2, 7), r.integers(1, 60)).astype(np.uint16)
        t, cap = (np.tile(t[: max(1, len(t) // 4)], 4) if k % 3 == 0 else t), int(r.integers(2, 70))
        sa, lcp = induced.suffix_array(t, cap, True)
        text = t.tolist()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert sa.tolist() == want
        for i, (a, b) in enumerate(zip(want, want[1:])):
            n = next((j for j in range(len(text)) if max(a, b) + j >= len(text) or text[a + j] != text[b + j]), len(text))
            assert lcp[i + 1] == min(n, cap)
    assert any(read) == (in_memory == 0)


@pytest.mark.parametrize("kind", range(4))
def test_quotient_filters_merge_without_loss(kind):
    """Encoded and decoded, cut into bytes and merged in any split, the multiset stays."""
    C = exact.CountingQuotientFilter
    r = np.random.default_rng(4)
    for _ in range(40):
        n = int(r.integers(0, 400))
        f = [r.integers(0, 2**64, n, dtype=np.uint64), r.integers(0, 50, n).astype(np.uint64) << np.uint64(int(r.integers(0, 58))), np.full(n, 2**64 - 1, np.uint64), r.integers(0, 300, n).astype(np.uint64)][kind]
        want = [x.tolist() for x in np.unique(f, return_counts=True)]
        assert [x.tolist() for x in C.of(f).items()] == want
        assert [x.tolist() for x in C.from_bytes(C.of(f).to_bytes()).items()] == want
        parts = np.array_split(r.permutation(f), int(r.integers(1, 9)))
        assert [x.tolist() for x in C.all_merged([C.of(x) for x in parts]).items()] == want


def test_quotient_filters_store_remainders_and_counters():
    """One run for two fingerprints that share a quotient; a counter of several digits; few bytes a fingerprint."""
    C = exact.CountingQuotientFilter
    r = np.random.default_rng(1)
    big = C.encoded(np.array([3, 9], np.uint64), np.array([2**60 + 5, 1], np.uint64))
    assert C.from_bytes(big.to_bytes()).items()[1].tolist() == [2**60 + 5, 1] and big.counter.sum() > 1
    f = np.unique(r.integers(0, 2**64, 50_000, dtype=np.uint64))
    c = C.of(f)
    assert c.occupied.sum() == c.runend.sum() < len(f) == len(c.slots) and int(c.slots.max()) < 2 ** (64 - c.q)
    assert len(c.to_bytes()) < 7 * len(f)


def test_copies_equal_brute_force(spark, docs):
    some = docs + [(900, "a b"), (901, "ab "), (902, "a  b"), (903, "\ta\nb")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256, r.kept) for r in exact.exact_dedup(frame(spark, some)).collect()}
    assert got == {d: (k, n, s, k == d) for d, (k, n, s) in brute.copies(some).items()}


def test_copies_without_ids_and_repeated_rows(spark):
    rows = exact.exact_dedup(frame(spark, [(None, "x y"), (1, "xy"), (1, "xy"), (None, None), (2, "z")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in rows) == [(0, 0, 1, True), (0, 0, 3, True), (1, 0, 3, False), (1, 0, 3, False), (2, 2, 1, True)]


def test_all_fingerprint_collisions_are_verified(spark, docs, monkeypatch):
    """Documents of one fingerprint are all compared byte by byte, and the result is the same."""
    few = [d for d in docs if len(d[1] or "") < 2000]
    batch = {"lens": np.array([len((t or "").encode()) for _, t in few]).tobytes(), "body": zstandard.ZstdCompressor(1).compress("".join(t or "" for _, t in few).encode())}
    monkeypatch.setattr(exact.xxhash, "xxh3_64_intdigest", lambda t: 7)
    own = exact.Fingerprints(batch, 4)
    rows = rows_of(own.rows(5))
    got = list(exact.merge_filters(iter([pa.RecordBatch.from_pylist(rows)])))
    assert len(rows) == 1 and all(own.repeated(got[0]["part"], got[0]["bits"]))


def test_verification_tells_different_texts_of_one_hash():
    z = zstandard.ZstdCompressor(1).compress
    rows = lambda *x: iter([pa.RecordBatch.from_pylist([{"sha": s, "body": z(t)} for s, t in x])])
    assert [r["sha"] for r in exact.verify(rows((b"1", b"a"), (b"1", b"a"), (b"2", b"b")))] == [[b"1", b"2"]]
    with pytest.raises(RuntimeError):
        list(exact.verify(rows((b"1", b"a"), (b"1", b"b"))))


def near_copies(seed):
    r = random.Random(seed)
    docs = []
    for g in range(12):
        base = [r.choice("abcdefghijk") * r.randint(1, 4) for _ in range(r.randint(1, 400))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "changed"
            docs.append((len(docs) + 3, " ".join(w)))
    return docs + [(0, None), (1, " "), (500, ""), (501, docs[0][1].upper())]


def test_near_copies_equal_brute_force(spark):
    docs = near_copies(1)
    prints = {d: brute.fingerprint(t) for d, t in docs}
    want = brute.components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_dedup(frame(spark, docs)).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}
    assert len(set(want.values())) < len({t for _, t in docs})


@pytest.mark.parametrize("run,room,hot", [(256, 1 << 22, 0.0), (3, 700, 0.0), (256, 1 << 22, 1.0), (3, 700, 0.5)])
@pytest.mark.parametrize("hot_segment", [False, True])
def test_no_link_is_lost(monkeypatch, run, room, hot, hot_segment):
    """Whatever keys are cut into pieces, and however runs are searched; also where all share a segment."""
    monkeypatch.setattr(simhash, "SHIFT_RUN", run)
    monkeypatch.setattr(simhash, "RUN_ROOM", room)
    r = np.random.default_rng(6)
    base = r.integers(0, 2**64, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base[:25] ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in r.integers(0, 64, (12, 2))]]))
    if hot_segment:
        fp = np.unique((r.integers(0, 2**12, 400).astype(np.uint64) << np.uint64(20)) | np.uint64(7 << 40))
    part, v, own = simhash.scattered(fp, 5, r.random(1 << 12) < hot, 12)
    at, links = {x: i for i, x in enumerate(fp.tolist())}, [(np.zeros(0, int),) * 2]
    for p in range(5):
        links.append([np.array([at[x] for x in y.tolist()], int) for y in simhash.near_links(v[part == p], own[part == p])])
    got = components.local_roots(len(fp), *(np.concatenate(x) for x in zip(*links, strict=True)))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2)
    assert (got == components.local_roots(len(fp), i, j)).all()


def test_hot_keys_are_found_and_cut(spark, monkeypatch):
    """A third of all fingerprints share a segment: their keys are cut, and the links are the same."""
    monkeypatch.setattr(simhash, "HOT", 100)
    r = np.random.default_rng(3)
    fp = np.unique(np.r_[r.integers(0, 2**64, 800, dtype=np.uint64), r.integers(0, 2**14, 500).astype(np.uint64) | np.uint64(5 << 32)])
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(3)
    bitmap, bits = simhash.hot_counters(df, len(fp))
    hot = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)
    keys = simhash.variant_keys(fp, 40)  # a variant of the upper segment
    assert hot[simhash.counter(keys[fp >> np.uint64(32) == 5], bits)].all() and not hot.all()
    got = simhash.simhash_links(df, len(fp), 6).collect()
    at = {x: i for i, x in enumerate(fp.view(np.int64).tolist())}
    label = components.local_roots(len(fp), np.array([at[x.a] for x in got]), np.array([at[x.b] for x in got]))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2)
    assert (label == components.local_roots(len(fp), i, j)).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 60)] + [(5, 5), (1000, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [*range(7, 60), 1000]}}


def test_contamination_equals_brute_force(spark):
    r = random.Random(8)
    word = lambda: r.choice("abcdeé") * r.randint(1, 2)
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(25)] + [(99, None), (98, "é--É!")]
    docs = [(d, " , ".join([r.choice(items)[1] or "x" if r.random() < 0.4 else " ".join(word().upper() for _ in range(r.randint(0, 60))) for _ in range(5)])) for d in range(50)] + [(77, None), (78, "")]
    found = decontam.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute.contamination(docs, items)
    assert {x.doc_id: (x.n_words, sum(s.end - s.start for s in x.spans), x["items"]) for x in found} == {d: w[:3] for d, w in want.items()}


def test_proximity_finds_moved_words(spark):
    phrase = "one two three four five six seven eight nine ten eleven twelve thirteen"
    moved = "zero one two three four six five seven eight nine ten extra eleven twelve thirteen more"
    found = decontam.decontaminate(frame(spark, [(1, moved), (2, "one two " + "x " * 90 + "thirteen"), (3, phrase)]), spark.createDataFrame([(1, phrase)], "item_id long, text string"))
    assert {r.doc_id: (len(r.spans), r.n_near > 0) for r in found.collect()} == {1: (0, True), 2: (0, False), 3: (1, False)}


def test_query_groups_give_the_same(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(d, (t or "")[:400]) for d, t in docs[:30]], "item_id long, text string")
    one = sorted(map(str, decontam.decontaminate(frame(spark, docs), bench).collect()))
    monkeypatch.setattr(decontam, "QUERY_BYTES", 100)
    assert sorted(map(str, decontam.decontaminate(frame(spark, docs), bench).collect())) == one


def test_packing_round_trip(spark, docs):
    docs = docs + [(800, "two  spaces\tand <|endoftext|> more"), (801, "don't 12ab ×÷ ʼn"), (802, " x")]
    rows = packing.pack_sequences(frame(spark, docs)).collect()
    lib = packing.Encoder(packing.vocabulary()).lib
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {d for d, _ in docs}
    for d, t in docs:
        ids, at = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for s in by.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or (at < 1024 and at & (at - 1) == 0)


def test_best_fill_equals_all_subsets():
    r = random.Random(3)
    for _ in range(200):
        counts = {n: r.randint(1, 3) for n in r.sample(range(1, 40), r.randint(1, 4))}
        room = r.randint(1, 90)
        sums = {0}
        for n, k in counts.items():
            sums = {s + i * n for s in sums for i in range(k + 1)}
        got = packing.best_fill(counts, sorted(counts, reverse=True), room)
        assert sum(n * k for n, k in got) == max(s for s in sums if s <= room) and all(k <= counts[n] for n, k in got)


def test_pii_base_equals_plain_patterns():
    import re

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("a1.@+- 9(é") for _ in range(r.randint(0, 50)))
        want = [("email", *m.span()) for m in email.finditer(t)]
        want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert pii.detect(t) == want


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("é mail john (at) mail [dot] example (dot) com now", "email", "john (at) mail [dot] example (dot) com"),
        ("john at example dot com", "email", "john at example dot com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ!", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("to jоhn@exаmple.com.", "email", "jоhn@exаmple.com"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("four one one one 1111 1111 one one one one", "card", "four one one one 1111 1111 one one one one"),
        ("at 192[.]168[.]1[.]10 here", "ip", "192[.]168[.]1[.]10"),
    ],
)
def test_pii_deobfuscation_maps_back(text, kind, span):
    base, added = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in added] == [(kind, span)] and not [b for b in base if b[0] == kind]


def test_pii_keeps_base_and_bounds_time(spark):
    docs = [(1, "a@b.co 1.2.3.4; 4111 1111 1111 1111 +1 (017) 555-7713"), (2, None), (3, ""), (4, "1" * 200_000 + "." * 1000 + "@" * 1000), (5, "x" * 200_000 + "@")]
    got = {r.doc_id: r for r in pii.pii_spans(frame(spark, docs)).collect()}
    assert [s.kind for s in got[1].base] == ["email", "ip", "card", "phone"] and all(not got[d].base for d in (2, 3, 4, 5))
    assert pii.digest([s.asDict() for s in got[1].base]).startswith("email:0:6,ip:7:14,card:16:35,phone:36:")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~common.held_out()))
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang", common.held_out().alias("h")), "doc_id").where("h").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "der hund", "de"), (3, None, "de"), (4, "123 !", None), (5, "x" * 300_000, None), (None, "the", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[1].lang_pred == "en" and got[2].lang_pred == "de" and 0 <= got[5].score <= 1
    none = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_language_of_equal_posteriors_and_clashing_columns(spark):
    """Of equals the first language by name; other columns aren't read; an empty table gives an empty result."""
    cols = "doc_id long, text string, lang string, lang_pred string, score string, bucket int, n long"
    docs = spark.createDataFrame([(1, "ab", "b", "x", "y", 1, 2), (2, "ab", "a", "x", "y", 1, 2), (3, "zz", None, "x", "y", 1, 2)], cols)
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[1] == got[2] == ("a", 0.5) and got[3][0] == "a"
    assert langid.identify(docs.where("false"), model).count() == 0


@pytest.mark.parametrize("op", [toxicity, quality])
def test_classifiers_without_documents(spark, op):
    """Nothing to learn from and nothing to score; every text below a half, then."""
    label = "toxic" if op is toxicity else "quality"
    docs, labels = frame(spark, []), spark.createDataFrame([(1, 1), (2, 0)], f"doc_id long, {label} int")
    model = op.fit(docs, labels)
    assert toxicity.scored(docs, model, 5, 0).count() == 0
    ones = spark.createDataFrame([(d, 1) for d in range(9)], f"doc_id long, {label} int")
    for m in (model, op.fit(frame(spark, [(d, "a b") for d in range(9)]), ones)):
        assert {r.predicted for r in toxicity.scored(frame(spark, [(1, "x"), (None, None)]), m, 5, 0).collect()} == {0}


@pytest.mark.parametrize("op,label,mod,rest,least", [("toxicity", "toxic", 5, 0, 0.97), ("quality", "quality", 3, 1, 0.98)])
def test_classifier_held_out_accuracy(spark, op, label, mod, rest, least):
    from slateledger.llm.toxicity import scored

    fit = {"toxicity": toxicity.fit, "quality": quality.fit}[op]
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    own = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = scored(own, fit(own, labels), mod, rest).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r[label] for r in got) / len(got) > least and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("op", [toxicity, quality])
def test_classifier_edges(spark, op):
    label = "toxic" if op is toxicity else "quality"
    docs = frame(spark, [(1, None), (2, ""), (3, "you idiot " * 20_000), (4, "a"), (4, "a"), (None, "b")])
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (3, 1), (None, 1), (4, 0)], f"doc_id long, {label} int")
    for lab in (labels, labels.where("false")):
        got = docs.select(toxicity.scorer(docs, op.fit(docs, lab)).alias("s")).collect()
        assert len(got) == 6 and all(0 <= r.s <= 1 for r in got)


@pytest.mark.parametrize(
    "op",
    [substring.repeated_passages, suffix.repeated_bytes, exact.exact_dedup, simhash.simhash_dedup, packing.pack_sequences, pii.pii_spans],
)
def test_empty_tables_and_odd_rows(spark, op):
    assert op(frame(spark, EMPTY)).count() == 0
    odd = [(None, None), (1, None), (1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (None, "a")]
    assert op(frame(spark, odd)).select("doc_id").distinct().count() == 4


def test_empty_index_and_benchmark(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(frame(spark, EMPTY), bench).count() == 0
    assert all(not r.spans for r in decontam.decontaminate(frame(spark, docs), bench).collect())


def test_hash_is_the_contracts():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


@pytest.mark.parametrize("lengths", [[600], [1023, 513], [1, 1024, 2048], [700, 600, 333]])
def test_packing_holds_a_bounded_pool(monkeypatch, lengths):
    monkeypatch.setattr(packing, "POOL", 2000)
    p, most, rows, n = packing.Packer(), 0, [], 50_000
    for d in range(n):
        k = lengths[d % len(lengths)]
        p.add(d, np.arange(k, dtype="<u4").tobytes())
        if p.held > 2 * packing.POOL:
            p.fill(packing.POOL)
        most = max(most, p.held)
        rows += p.take()
    p.fill(0)
    rows += p.take()
    assert most <= 2 * packing.POOL + 1
    doc, start, length, _, total, seq, offset = (np.array(c) for c in zip(*rows))
    at = np.lexsort((start, doc))  # every id in one piece
    assert (start[at] == np.where(np.r_[True, doc[at][1:] != doc[at][:-1]], 0, np.r_[0, (start + length)[at][:-1]])).all()
    assert np.bincount(doc, weights=length).tolist() == [lengths[d % len(lengths)] for d in range(n)]
    at = np.lexsort((offset, seq))  # gapless
    assert (offset[at] == np.where(np.r_[True, seq[at][1:] != seq[at][:-1]], 0, np.r_[0, (offset + length)[at][:-1]])).all()
    size = np.bincount(seq, weights=length).astype(int)
    assert all(x == 1024 or (x < 1024 and x & (x - 1) == 0) for x in size.tolist()) and (size < 1024).sum() <= 10


def test_samples_are_bounded_by_rows(spark):
    """A labelled id that 50,000 empty texts repeat, and the order of the others' bytes."""
    from slateledger.llm.labelled import sample

    many = spark.range(50_000).selectExpr("7 as doc_id", "cast(case when id % 2 = 0 then '' end as string) as text")
    few = spark.createDataFrame([(d, "x" * 100) for d in range(20, 60)] + [(None, "y")], "doc_id int, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in (7, *range(20, 60))] + [(7, 1), (None, 1), (20, None)], "doc_id int, toxic int")
    out = sample(many.unionByName(few), labels, "toxic", 5, 4, 100)
    assert out.count() == 100 and "Window" not in out._jdf.queryExecution().toString()
    assert sample(few, labels, "toxic", 5, 4, 100, most_bytes=950).count() == 9 and sample(few, labels, "toxic", 5, 4, 3).count() == 3
    assert sample(few.limit(0), labels, "toxic", 5, 4, 100).count() == 0 and sample(few, labels.limit(0), "toxic", 5, 4, 100).count() == 0


@pytest.mark.parametrize("operator", ["substring", "exact", "suffix"])
def test_batches_keep_their_documents(spark, docs, operator):
    """An input that comes in another order at every read: answers still meet the batches that asked."""
    from pyspark.sql import functions as F

    run = {"substring": lambda x: substring.repeated_passages(x, window=8), "exact": exact.exact_dedup, "suffix": lambda x: suffix.repeated_bytes(x, window=40)}[operator]
    df = frame(spark, docs)
    want = {r.doc_id: r for r in run(df).collect()}
    # a seed of its own for each run of a task, by the clock of the worker
    shuffled = df.select("doc_id", "text").mapInPandas(lambda it: (b.sample(frac=1, random_state=__import__("time").time_ns() % 2**32) for b in it), "doc_id long, text string").withColumn("n", F.lit(1))
    assert {r.doc_id: r for r in run(shuffled).collect()} == want
