"""Benchmark decontamination over a distributed positional inverted index of the training tokens.

The index is cut by documents: each row holds the postings of one block of documents, for every term
the sorted positions at which it occurs. A phrase is looked up in every block by intersecting its
terms' posting lists, each moved back by the term's offset in the phrase, from the rarest term on.
Benchmark texts come in groups of bounded size, one after the other; what a group finds is kept as a
table of the documents hit, and the groups' tables are put together by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateledger.llm.common import arrow_map, as_bytes, save, table, texts

WINDOW = 13
#: Words of slack about a window within which a proximity match may have its terms in any order.
SLOP = 5
#: Bytes of text that one block of the index covers (a longer document is a block of its own).
BLOCK_BYTES = 4 << 20
#: Benchmark texts are searched in groups of about so many bytes (a longer text is a group of its own): the
#: driver and every task hold one group at a time.
QUERY_BYTES = 8 << 20
#: Bits of the table of terms and documents that are intersected at once.
SHARE_BITS = 1 << 23
HITS = "n int, spans array<struct<start:long,end:long>>, items array<string>, n_near long"

_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20) for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (A-Z folded), digits and non-ASCII characters."""
    return (text or b"").translate(_FOLD).split()


def postings(docs: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, the count of each, all positions term by term, and the documents' lengths.

    Positions run through the block; documents are one position apart so that no phrase crosses them.
    """
    number: dict[bytes, int] = {}
    ids, lens, get = [], [], number.setdefault
    for ws in docs:
        ids.append(np.array([get(w, len(number)) for w in ws], np.int32))
        lens.append(len(ws))
    lens = np.array(lens, np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(lens)), lens)
    order = np.argsort(flat, kind="stable")
    return list(number), np.bincount(flat, minlength=len(number)), at[order].astype(np.int32), lens


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of documents: block, doc_ids, lens, terms, counts, positions (compressed). A block's
    number comes from the input's partition, so it is settled only once the index is written."""
    src = texts(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pack, block, ids, held, size = zstandard.ZstdCompressor(1), TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> dict:
            terms, counts, at, lens = postings(held)
            return {"block": [block], "doc_ids": [ids], "lens": [lens.tobytes()], "terms": [pack.compress(b" ".join(terms))], "counts": [counts.astype(np.int32).tobytes()], "positions": [pack.compress(np.diff(at, prepend=np.int32(0)).tobytes())]}

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids.append(doc)
                held.append(words(text))
                size += len(text or b"") + 16
                if size >= BLOCK_BYTES:
                    yield row()
                    block, ids, held, size = block + 1, [], [], 0
        if ids:
            yield row()

    return arrow_map(src, build, f"block long, doc_ids array<{kind}>, lens binary, terms binary, counts binary, positions binary")


class Queries:
    """Windows of a group of benchmark items over their own vocabulary."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        number: dict[bytes, int] = {}
        seen: dict[bytes, int] = {}
        self.windows, owners = [], []
        for item, ws in items:
            ids = np.array([number.setdefault(w, len(number)) for w in ws], np.int32)
            for k in range(max(1, len(ids) - window + 1) if len(ids) else 0):
                w = ids[k : k + window]
                at = seen.setdefault(w.tobytes(), len(seen))
                if at == len(self.windows):
                    self.windows.append(w)
                    owners.append(set())
                owners[at].add(item)
        self.terms, self.owners = number, [sorted(x) for x in owners]
        self.size = np.array([len(w) for w in self.windows], np.int64)
        self.padded = np.full((len(self.windows), window), -1, np.int32)
        for k, w in enumerate(self.windows):
            self.padded[k, : len(w)] = w


class Postings:
    """A block's lists for the terms of some queries."""

    def __init__(self, row: dict, terms: dict[bytes, int]):
        unpack = zstandard.ZstdDecompressor()
        self.lens = np.frombuffer(row["lens"], np.int64)
        own = unpack.decompress(row["terms"]).split(b" ")
        counts = np.frombuffer(row["counts"], np.int32)
        bounds = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        self.positions = np.cumsum(np.frombuffer(unpack.decompress(row["positions"]), np.int32), dtype=np.int32)
        self.count, self.first = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        if len(counts):
            get = terms.get
            number = np.array([get(t, -1) for t in own], np.int64)
            mine = np.flatnonzero(number >= 0)
            self.count[number[mine]], self.first[number[mine]] = counts[mine], bounds[mine]

        self.begin, self.mine = np.r_[0, np.cumsum(self.lens + 1)], np.flatnonzero(self.count)

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term] + self.count[term]]

    def within(self, term: int, doc: int) -> np.ndarray:
        """A term's positions in one document."""
        every = self.of(term)
        a, b = every.searchsorted(self.begin[doc : doc + 2].astype(np.int32))
        return every[a:b]

    def together(self, windows: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, document) wherever a document has all terms of a window (-1 for none): rows of a bit for
        each document are intersected, a bounded share of documents and windows at once."""
        if not len(self.mine):
            return
        at = np.concatenate([self.of(t) for t in self.mine.tolist()])
        term = np.repeat(np.arange(len(self.mine)), self.count[self.mine])
        docs, doc = np.unique(np.searchsorted(self.begin, at, side="right") - 1, return_inverse=True)
        row = np.full(len(self.count) + 1, len(self.mine))  # absent terms have an empty row
        row[self.mine], row[-1] = np.arange(len(self.mine)), len(self.mine) + 1
        of, step = row[windows], max(64, SHARE_BITS // (len(self.mine) + 2) // 64 * 64)
        for k in range(0, len(docs), step):
            own = (doc >= k) & (doc < k + step)
            has = np.zeros((len(self.mine) + 2, min(step, len(docs) - k)), bool)
            has[term[own], doc[own] - k], has[-1] = True, True
            bits = np.packbits(has, axis=1)
            lot = max(1, SHARE_BITS // 8 // bits.shape[1])
            for w in range(0, len(of), lot):
                every = bits[of[w : w + lot, 0]]
                for j in range(1, of.shape[1]):
                    every &= bits[of[w : w + lot, j]]
                some = np.flatnonzero(every.any(axis=1))
                i, d = np.nonzero(np.unpackbits(every[some], axis=1, count=has.shape[1]))
                yield from zip((some[i] + w).tolist(), docs[d + k].tolist(), strict=True)


def intersect(starts: np.ndarray, other: np.ndarray, offset: int) -> np.ndarray:
    """Of the sorted starts those s with s + offset in the other sorted list."""
    at = np.searchsorted(other, starts + offset)
    at[at == len(other)] = 0
    return starts[other[at] == starts + offset] if len(other) else starts[:0]


def phrase(lists: list[np.ndarray]) -> np.ndarray:
    """Starts of exact occurrences, from the positions of each word of a window in a document: offset-adjusted
    lists, from the rarest term on."""
    order = np.argsort([len(x) for x in lists], kind="stable").tolist()
    starts = lists[order[0]] - np.int32(order[0])
    for k in order[1:]:
        if not len(starts):
            break
        starts = intersect(starts, lists[k], k)
    return starts


def proximity(lists: list[np.ndarray], reach: int) -> np.ndarray:
    """Positions of a document's rarest term of the window (of equals the first) that have every other one
    within reach in the same document."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    at = lists[order[0]]
    for k in order[1:]:
        at = at[np.searchsorted(lists[k], at - reach) < np.searchsorted(lists[k], at + reach, side="right")]
        if not len(at):
            break
    return at


def search_block(row: dict, queries: Queries, window: int, slop: int) -> list[tuple[int, np.ndarray, list[str], int]]:
    """For documents of a block with any match: (number in it, hit intervals, items, proximity matches)."""
    index = Postings(row, queries.terms)
    found: dict[int, tuple[list, set, int]] = {}
    for k, d in index.together(queries.padded):
        w = queries.windows[k]
        of = {t: index.within(t, d) for t in w.tolist()}
        at = proximity(list(of.values()), np.int32(len(w) + slop))
        if not len(at):  # nor is the phrase here, then
            continue
        starts = phrase([of[t] for t in w.tolist()])
        if len(starts):  # places in exact matches aren't near ones
            last = np.searchsorted(starts, at, side="right") - 1
            at = at[(last < 0) | (at >= starts[last] + len(w))]
        if len(starts) or slop and len(at):
            spans, items, near = found.setdefault(d, ([], set(), 0))
            spans += [(s, s + len(w)) for s in (starts - index.begin[d]).tolist()]
            items.update(queries.owners[k] if len(starts) else ())
            found[d] = (spans, items, near + (len(at) * len(queries.owners[k]) if slop else 0))
    return [(d, np.array(spans, np.int64).reshape(-1, 2), sorted(items), near) for d, (spans, items, near) in found.items()]


def covered(spans: np.ndarray) -> np.ndarray:
    """The union of intervals, as sorted disjoint ones."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > top[:-1]]
    return np.c_[spans[new, 0], top[np.r_[np.flatnonzero(new)[1:] - 1, len(top) - 1]]]


def query_groups(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, in groups of QUERY_BYTES, read one partition at a time; a null id counts as the empty text."""
    held, size = [], 0
    for item, text in texts(benchmark, item_id, item_text).select("doc_id", "text").toLocalIterator():
        if ws := words((text or "").encode()):
            held.append(("" if item is None else str(item), ws))
            size += len(text)
        if size >= QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def search_group(index: DataFrame, group: list[tuple[str, list[bytes]]], window: int, slop: int) -> DataFrame:
    """(block, n, spans, items, n_near): the documents with any match of a group, by number in their block."""
    shared = index.sparkSession.sparkContext.broadcast(group)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ready = Queries(shared.value, window)
        for batch in batches:
            for row in batch.to_pylist():
                found = search_block(row, ready, window, slop)
                spans = [[{"start": a, "end": b} for a, b in covered(x[1]).tolist()] for x in found]
                yield {"block": [row["block"]] * len(found), "n": [x[0] for x in found], "spans": spans, "items": [x[2] for x in found], "n_near": [x[3] for x in found]}

    found = save(arrow_map(index.select("block", "lens", "terms", "counts", "positions"), look, f"block long, {HITS}"))
    shared.unpersist()
    return found


def search(index: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per document: doc_id, n_words, spans (exact matches, in words), items, n_near.

    index is a written one. The benchmark, a stated set of queries, is searched group by group in every
    block; results don't depend on how documents fall into blocks or items into groups. n_near counts, for
    every window of an item, the places where its rarest word in the document has all others near.
    """
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    hits = index.sparkSession.createDataFrame([], f"block long, {HITS}")
    for group in query_groups(benchmark, item_id, item_text):
        hits = hits.unionByName(search_group(index, group, window, slop))
    by_block = hits.groupBy("block").agg(F.collect_list(F.struct("n", "spans", "items", "n_near")).alias("hits"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.frombuffer(row["lens"], np.int64)
                spans, items, near = [[] for _ in lens], [[] for _ in lens], [0] * len(lens)
                for h in row["hits"] or []:
                    k = h["n"]
                    every = np.array([(x["start"], x["end"]) for x in [*spans[k], *h["spans"]]], np.int64).reshape(-1, 2)
                    spans[k] = [{"start": a, "end": b} for a, b in covered(every).tolist()]
                    items[k] = sorted({*items[k], *h["items"]})
                    near[k] += h["n_near"]
                yield {"doc_id": row["doc_ids"], "n_words": lens, "spans": spans, "items": items, "n_near": near}

    blocks = index.select("block", "doc_ids", "lens").join(by_block, "block", "left").select("doc_ids", "lens", "hits")
    return arrow_map(blocks, together, f"doc_id {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>, n_near long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """search() over a fresh index of docs, kept as a table in the shared folder.

    Null texts have no words; an item without words has no window; repeated rows give repeated results.
    An empty benchmark matches nothing; an empty table of documents gives an empty result.
    """
    return search(save(build_index(docs, id_col, text_col), **{"parquet.block.size": 16 << 20}), benchmark, window=window)


def op5_decontam(spark, sf_dir):
    """A document is contaminated if at least a twentieth of its words is hit."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = b.select(["n_words", "spans", "items", "n_near"]).to_pylist()
            hit = [sum(s["end"] - s["start"] for s in r["spans"]) for r in rows]
            yield {"doc_id": b.column(0), "n_words": b.column(1), "n_hit": hit, "n_items": [len(r["items"]) for r in rows], "items_sha256": [hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in rows], "contaminated": [h > 0 and 20 * h >= r["n_words"] for h, r in zip(hit, rows, strict=True)], "n_near": [r["n_near"] for r in rows]}

    return arrow_map(found, digest, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:least(k + 12, len(w))], ' ') AS g, least(13, len(w)) AS n
       FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(k) WHERE len(w) > 0),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM d, (SELECT DISTINCT n FROM iw) l, unnest(range(1, len(w) - n + 2)) t(k)),
m AS (SELECT doc_id, k, n, g, item_id FROM dw JOIN iw USING (g, n)),
h AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM m, unnest(range(n)) u(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM m GROUP BY doc_id),
wt AS (SELECT g, n, t, min(p) AS first_ FROM (SELECT g, n, unnest(string_split(g, ' ')) AS t, unnest(range(1, n + 1)) AS p FROM (SELECT DISTINCT g, n FROM iw) x) y GROUP BY g, n, t),
wn AS (SELECT g, count(*) AS terms FROM wt GROUP BY g),
ow AS (SELECT g, count(*) AS owners FROM iw GROUP BY g),
dp AS (SELECT * FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d) x WHERE t IN (SELECT t FROM wt)),
dc AS (SELECT doc_id, t, count(*) AS c FROM dp GROUP BY doc_id, t),
ca AS (SELECT doc_id, g, n, terms, rare FROM (SELECT doc_id, g, n, count(*) AS k, arg_min(t, c * 100 + first_) AS rare FROM dc JOIN wt USING (t) GROUP BY doc_id, g, n) q JOIN wn USING (g) WHERE k = terms),
at_ AS (SELECT ca.doc_id, ca.g, ca.n, terms, p FROM ca JOIN dp ON dp.doc_id = ca.doc_id AND dp.t = rare),
nr AS (SELECT a.doc_id, a.g, a.n, a.p FROM at_ a JOIN wt USING (g) JOIN dp q ON q.doc_id = a.doc_id AND q.t = wt.t AND q.p BETWEEN a.p - a.n - 5 AND a.p + a.n + 5
       GROUP BY a.doc_id, a.g, a.n, a.p, terms HAVING count(DISTINCT q.t) = terms),
nn AS (SELECT doc_id, sum(owners) AS n_near FROM nr JOIN ow USING (g) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = nr.doc_id AND m.g = nr.g AND m.k <= nr.p AND nr.p < m.k + m.n) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nn USING (doc_id)
"""
