"""Repeated byte strings through suffix arrays of shards on disk.

Every window of WINDOW bytes has a minimizer, the smallest hash among its runs of GRAM bytes (the leftmost
on ties): equal windows have equal minimizers at equal offsets. Windows whose minimizer occurs once are
unique. The others come to the shard of their minimizer, a run of windows about one occurrence as one
string; equal strings of a batch, told by 128 bits of their SHA-256, once with their number. A
shard keeps its strings in a file and sorts them by external induction, in lots of whole minimizers;
a window is repeated if its string occurs more than once or if its suffix shares WINDOW bytes with a
neighbour in suffix order. Strings about a minimizer with HOT or more occurrences would all come to one
task: their windows are dealt one by one, by the SHA-256 of their bytes, over all tasks.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateledger.llm import induced
from slateledger.llm.common import arrow_map, input_bytes, mix, parts_for, runs, table, texts
from slateledger.llm.exchange import ANSWER, ASK, Ask, count_keys, counted, packed, unpack, with_answers
from slateledger.llm.substring import cover, rolling

WINDOW, GRAM = 400, 24
#: Text of one packed batch; numbers of eight bytes are held for each of its bytes.
BATCH_BYTES = 1 << 20
#: A lot ends with the minimizer that brings it to so many bytes.
SORT_BYTES = 4 << 20
#: Occurrences from which on a minimizer's windows are dealt one by one; a minimizer below it has strings of
#: some 3 MB at most, whatever the size of the input.
HOT = 4096
#: What a row of an exchange is, and the part that tells a batch's own memo and answers to single windows.
MEMO, STRINGS, WINDOWS = 0, 1, 2
PIECES = "part int, bid long, kind int, keys binary, tags binary, counts binary, spans binary, body binary"


class Bytes:
    """A batch of documents as one array of bytes."""

    def __init__(self, docs: list[bytes]):
        self.lens = np.array(list(map(len, docs)), np.int64)
        self.begin = np.r_[0, np.cumsum(self.lens)]
        self.text = b"".join(docs)
        self.flat = np.frombuffer(self.text, np.uint8)

    def windows(self, size: int) -> np.ndarray:
        left = np.repeat(self.begin[1:], self.lens) - np.arange(len(self.flat))
        return np.flatnonzero(left >= size)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum over every run of `size` elements, by doubling."""
    have = 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if have < size else x


def minimizers(flat: np.ndarray, starts: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimizer's position for each window, the distinct positions, and the hashes of the grams there."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, low = rolling(mix(np.arange(256, dtype=np.uint64), 5)[flat], gram), np.uint64((1 << 28) - 1)
    at = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), size - gram + 1) & low).astype(np.int64)[starts]
    places = at[np.r_[True, at[1:] != at[:-1]]]
    return at, places, grams[places]


def sha(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the SHA-256 of each string, as two arrays of numbers."""
    view, one = memoryview(text), hashlib.sha256
    both = np.frombuffer(b"".join([one(view[a:b]).digest()[:16] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Pieces:
    """A batch's runs of windows about one occurrence of a repeated minimizer."""

    def __init__(self, row: dict, parts: int, part: list[int], bits: list[bytes], window: int, gram: int):
        self.bytes, self.window = Bytes(unpack(row)), window
        text, starts = self.bytes.text, self.bytes.windows(window)
        at, places, keys = minimizers(self.bytes.flat, starts, window, gram)
        repeated, hot = Ask(keys, parts).answer(part, bits, planes=2)
        flag, key_at = np.zeros((2, len(text) + 1), bool), np.zeros(len(text) + 1, np.uint64)
        flag[0, places], flag[1, places], key_at[places] = repeated, hot, keys
        self.single = starts[flag[1, at]]  # windows about a hot minimizer
        high, low = sha(text, self.single, self.single + window)
        self.by_window = Ask(high, parts, low)
        keep = flag[0, at] & ~flag[1, at]
        starts, at = starts[keep], at[keep]
        new = np.flatnonzero(np.r_[np.ones(min(1, len(at)), bool), (at[1:] != at[:-1]) | (np.diff(starts) != 1)])
        self.first, self.n = starts[new], np.diff(np.r_[new, len(starts)])
        high, low = sha(text, self.first, self.first + self.n + window - 1)
        order = np.lexsort((low, high))
        number = np.empty(len(order), np.uint64)
        number[order] = np.cumsum(np.r_[np.zeros(min(1, len(order)), bool), (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])
        self.ask = Ask(key_at[at[new]], parts, number)
        one = self.ask.order[self.ask.start]
        self.one_first, self.one_n, self.one_tag = self.first[one], self.n[one], np.stack([high[one], low[one]], axis=1)

    def rows(self, bid: int, parts: int) -> dict:
        a, z, text = self.ask, zstandard.ZstdCompressor(1), self.bytes.text
        strings, single = a.rows(bid), self.by_window.rows(bid)
        n, m = len(a.full), len(self.by_window.full)
        first, count = (np.split(x[a.deal], a.bounds[1:-1]) for x in (self.one_first, self.one_n))
        body = [z.compress(b"".join([text[s : s + k + self.window - 1] for s, k in zip(first[p].tolist(), count[p].tolist(), strict=True)])) for p in a.full]
        out = {c: [*strings[c], *single[c]] for c in ("part", "bid", "keys", "counts")}
        out |= {"kind": [STRINGS] * n + [WINDOWS] * m, "tags": [*a.cut(self.one_tag), *single["tags"]], "spans": [count[p].astype(np.uint32).tobytes() for p in a.full] + [b""] * m, "body": [*body, *[b""] * m]}
        memo = {"part": bid % parts, "bid": bid, "kind": MEMO, "body": self.memo()}
        return {c: [*v, memo.get(c, b"")] for c, v in out.items()}

    def memo(self) -> bytes:
        """What is needed to read the answers, so that nothing is searched for again."""
        a, w = self.ask, self.by_window
        arrays = [x.astype(np.int32) for x in (self.first, a.order, a.start, a.length, self.one_n, a.deal, a.bounds, self.single, w.order, w.length, w.deal, w.bounds)]
        return zstandard.ZstdCompressor(1).compress(pickle.dumps(arrays, protocol=5))


def repeated_starts(memo: bytes, strings: list[tuple[int, bytes]], single: list[tuple[int, bytes]]) -> np.ndarray:
    """Starts of the repeated windows of a batch, from the answers for its distinct strings and single windows."""
    first, order, start, length, span, deal, bounds, alone, w_order, w_length, w_deal, w_bounds = pickle.loads(zstandard.ZstdDecompressor().decompress(memo))
    hits, yes = [], np.zeros(len(w_length), bool)
    for p, data in single:
        at = w_deal[w_bounds[p] : w_bounds[p + 1]]
        yes[at] = np.unpackbits(np.frombuffer(data, np.uint8), count=len(at), bitorder="little")
    hits.append(alone[w_order[np.repeat(yes, w_length)]])
    for p, data in strings:
        got, done = np.frombuffer(data, np.uint8), 0
        for k in deal[bounds[p] : bounds[p + 1]].tolist():  # each string's bits begin with a byte
            size = (int(span[k]) + 7) // 8
            if (rel := np.flatnonzero(np.unpackbits(got[done : done + size], count=int(span[k]), bitorder="little"))).size:
                hits += [first[i] + rel for i in order[start[k] : start[k] + length[k]].tolist()]
            done += size
    return np.concatenate(hits).astype(np.int64)


def sort_shard(strings: list[bytes], spans: list[int], window: int) -> list[np.ndarray]:
    """For each of the distinct strings: which of its first `span` windows also start in another place."""
    lens = np.array(list(map(len, strings)), np.int64)
    begin = np.r_[0, np.cumsum(lens + 1)]
    t = np.ones(int(begin[-1]) + 1, np.uint16)
    t[-1] = 0  # 0 ends the shard, 1 ends a string, bytes follow
    for s, b in zip(strings, begin.tolist(), strict=False):
        t[b : b + len(s)] = np.frombuffer(s, np.uint8)
        t[b : b + len(s)] += 2
    yes = np.zeros(len(t), bool)
    for pos, lcp in induced.buckets(t, window):  # neighbours across buckets share nothing
        far = np.flatnonzero(lcp >= window)
        yes[pos[far]] = True
        yes[pos[far - 1]] = True
    return [yes[b : b + n] for b, n in zip(begin.tolist(), spans, strict=False)]


class Shard:
    """The strings of a part in a file of the task, some fifty bytes of each in memory; finds the windows of
    each that start in another place, too. The file goes with the object."""

    def __init__(self, window: int, sort_bytes: int):
        self.window, self.sort_bytes, self.file, self.size = window, sort_bytes, tempfile.TemporaryFile(), 0
        self.known: list[tuple[np.ndarray, ...]] = []

    def add(self, row: dict, unz: zstandard.ZstdDecompressor) -> int:
        """Put a row's strings into the file; their number."""
        body, n = unz.decompress(row["body"]), np.frombuffer(row["spans"], np.uint32).astype(np.int64)
        lens = n + self.window - 1
        self.file.write(body)
        tags = np.frombuffer(row["tags"], np.uint64).reshape(-1, 2)
        self.known.append((np.frombuffer(row["keys"], np.uint64), tags[:, 0], tags[:, 1], n, self.size + np.cumsum(lens) - lens, np.frombuffer(row["counts"], np.uint32).astype(np.int64)))
        self.size += len(body)
        return len(n)

    def solve(self) -> Iterator[bytes]:
        """For each string in the order of add(): the bits of its windows."""
        if not self.known:
            return
        key, high, low, n, at, count = (np.concatenate(x) for x in zip(*self.known, strict=True))
        self.known = []
        order = np.lexsort((low, high, key))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])]
        one, number = order[new], np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        total = np.add.reduceat(count[order], np.flatnonzero(new))
        span, place, size = n[one], at[one], (n[one] + 7) // 8
        base = np.r_[0, np.cumsum(size)]
        bits = np.zeros(int(base[-1]), np.uint8)
        for k in np.flatnonzero(total > 1).tolist():
            bits[base[k] : base[k + 1]] = np.packbits(np.ones(span[k], bool), bitorder="little")
        lot, held = [], 0
        for s, m in zip(*(x.tolist() for x in runs(key[one])), strict=True):
            if m > 1:  # a string alone with its minimizer has nothing to compare with
                lot += range(s, s + m)
                held += int(span[s : s + m].sum()) + m * self.window
                if held >= self.sort_bytes:
                    self.sort(lot, span, place, base, bits)
                    lot, held = [], 0
        self.sort(lot, span, place, base, bits)
        for k in number.tolist():
            yield bits[base[k] : base[k + 1]].tobytes()

    def sort(self, lot: list[int], span: np.ndarray, place: np.ndarray, base: np.ndarray, bits: np.ndarray) -> None:
        if not lot:
            return
        strings = []
        for k in lot:
            self.file.seek(place[k])
            strings.append(self.file.read(span[k] + self.window - 1))
        for k, yes in zip(lot, sort_shard(strings, span[lot].tolist(), self.window), strict=True):
            bits[base[k] : base[k + 1]] |= np.packbits(yes, bitorder="little")


def suffix_repeats(window: int, sort_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        unz, shard, asked, single = zstandard.ZstdDecompressor(), Shard(window, sort_bytes), [], []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["kind"] == MEMO:  # on its way back
                    yield {"bid": [row["bid"]], "part": [-1], "bits": [row["body"]]}
                elif row["kind"] == WINDOWS:
                    single.append(row)
                else:
                    asked.append((row["bid"], row["part"], shard.add(row, unz)))
        for row, n in zip(single, counted(*([r[c] for r in single] for c in ("keys", "tags", "counts"))), strict=True):
            yield {"bid": [row["bid"]], "part": [-2 - row["part"]], "bits": [np.packbits(n > 1, bitorder="little").tobytes()]}
        bits = shard.solve()
        for bid, part, n in asked:
            yield {"bid": [bid], "part": [part], "bits": [b"".join([next(bits) for _ in range(n)])]}

    return run


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, sort_bytes: int = SORT_BYTES, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed runs of bytes: start, end), kept (bytes left).

    A null text counts as empty; a text shorter than a window loses nothing; repeated rows are documents
    of their own, so each repeats the other. An empty table gives an empty result.
    """
    src = texts(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    parts = parts_for(input_bytes(src))
    batches = packed(src, parts, BATCH_BYTES)

    def ask_minimizers(rows: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in rows:
            for row in batch.to_pylist():
                b = Bytes(unpack(row))
                yield Ask(minimizers(b.flat, b.windows(window), window, gram)[2], parts).rows(row["bid"])

    def ask_pieces(row: dict, part: list[int], bits: list[bytes]) -> dict:
        return Pieces(row, parts, part, bits, window, gram).rows(row["bid"], parts)

    def finish(row: dict, part: list[int], bits: list[bytes]) -> dict:
        b, told = Bytes(unpack(row)), list(zip(part, bits, strict=True))
        hits = repeated_starts(bits[part.index(-1)], [x for x in told if x[0] >= 0], [(-2 - p, x) for p, x in told if p < -1])
        gone = cover(len(b.flat), hits, window)
        spans, kept = [], []
        for s, e in zip(b.begin[:-1].tolist(), b.begin[1:].tolist(), strict=True):
            g = gone[s:e]
            if not g.any():
                spans.append([])
                kept.append(b.text[s:e])
                continue
            turn = np.flatnonzero(np.diff(np.r_[0, g.astype(np.int8), 0]))
            spans.append([{"start": x, "end": y} for x, y in turn.reshape(-1, 2).tolist()])
            kept.append(b.flat[s:e][~g].tobytes())
        return {"doc_id": row["ids"], "n_bytes": b.lens, "spans": spans, "kept": kept}

    asked = arrow_map(batches, ask_minimizers, ASK).repartitionById(parts, F.col("part"))
    known = arrow_map(asked, count_keys(2, hot), ANSWER)
    pieces = with_answers(batches, known, ask_pieces, PIECES).repartitionById(parts, F.col("part"))
    repeats = arrow_map(pieces, suffix_repeats(window, sort_bytes), ANSWER)
    return with_answers(batches, repeats, finish, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op4_suffix_dedup(spark, sf_dir):
    found = repeated_bytes(table(spark, sf_dir, "documents"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            spans = b.column(2).to_pylist()
            yield {"doc_id": b.column(0), "n_bytes": b.column(1), "n_removed": [sum(s["end"] - s["start"] for s in x) for x in spans], "n_spans": [len(x) for x in spans], "kept_sha256": [hashlib.sha256(x).hexdigest() for x in b.column(3).to_pylist()]}

    return arrow_map(found, digest, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, k, md5(substr(x, 2 * k - 1, 800)) AS m FROM d, unnest(range(1, length(x) // 2 - 398)) t(k)),
r AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY m) AS c FROM g) WHERE c > 1),
i AS (SELECT doc_id, k, sum(CASE WHEN k - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS s
      FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM r)),
s AS (SELECT doc_id, min(k) AS a, max(k) + 400 AS b FROM i GROUP BY doc_id, s),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS from_ FROM s),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last_,
             string_agg(substr(x, 2 * from_ - 1, 2 * (a - from_)), '' ORDER BY a) AS front
      FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN last_ IS NULL THEN x ELSE front || substr(x, 2 * last_ - 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
