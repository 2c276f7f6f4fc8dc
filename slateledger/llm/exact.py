"""Exact duplicates: counting quotient filters route repeated fingerprints to byte verification.

Every batch of documents builds a counting quotient filter of its texts' fingerprints and sends slices of
it, by range of the fingerprint. A range's task merges the slices of all batches by their sorted
remainders and tells each batch which of its fingerprints count above one. Only texts with such a
fingerprint are compared, byte by byte; one copy of a text leaves each batch.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateledger.llm.common import arrow_map, input_bytes, parts_for, runs, save, table, texts
from slateledger.llm.exchange import ANSWER, packed, unpack, with_answers

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that stand for one byte of filter, roughly; sets how many ranges of fingerprints there are.
TEXT_A_FILTER_BYTE = 64
FILTER = "part int, bid long, filter binary"


class CountingQuotientFilter:
    """Fingerprints of 64 bits, each with a count, as quotients and sorted remainders.

    The upper q bits of a fingerprint are its quotient, the others its remainder. `occupied` has a bit for
    each quotient from `first` on that has a run; the runs' slots lie one after the other, remainders in
    order; `runend` marks a run's last slot. A remainder that counts more than once is followed by slots
    that `counter` marks: the digits of its count less one, lowest first.
    """

    HEADER = struct.Struct("<BQQQ")

    def __init__(self, q: int, first: int, quotients: int, occupied: np.ndarray, runend: np.ndarray, counter: np.ndarray, slots: np.ndarray):
        self.q, self.first, self.quotients, self.occupied, self.runend, self.counter, self.slots = q, first, quotients, occupied, runend, counter, slots

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        f = np.sort(fingerprints)
        start, count = runs(f)
        return cls.encoded(f[start], count.astype(np.uint64))

    @classmethod
    def encoded(cls, f: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """From distinct fingerprints in order and their counts; about as many quotients as fingerprints."""
        if not len(f):
            return cls(1, 0, 0, *(np.zeros(0, bool) for _ in range(3)), np.zeros(0, np.uint64))
        q = min(56, max(1, round(math.log2(len(f) * 2.0**64 / (int(f[-1]) - int(f[0]) + 1)))))
        quotient = (f >> np.uint64(64 - q)).astype(np.int64)
        width = np.uint64((1 << (64 - q)) - 1)
        more, digits = counts - np.uint64(1), np.zeros(len(f), np.int64)
        left = more.copy()
        while left.any():
            digits += left > 0
            left >>= np.uint64(64 - q)
        at = np.r_[0, np.cumsum(1 + digits)]
        slots, counter, runend = np.zeros(at[-1], np.uint64), np.ones(at[-1], bool), np.zeros(at[-1], bool)
        slots[at[:-1]], counter[at[:-1]] = f & width, False
        for k in range(int(digits.max())):
            own = np.flatnonzero(digits > k)
            slots[at[own] + 1 + k] = (more[own] >> np.uint64(k * (64 - q))) & width
        last = np.r_[quotient[1:] != quotient[:-1], True]
        runend[at[1:][last] - 1] = True
        occupied = np.zeros(int(quotient[-1] - quotient[0]) + 1, bool)
        occupied[quotient - quotient[0]] = True
        return cls(q, int(quotient[0]), len(occupied), occupied, runend, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints in order, and their counts."""
        at = np.flatnonzero(~self.counter)
        run = (np.cumsum(self.runend) - self.runend)[at]
        quotient = (np.flatnonzero(self.occupied)[run] + self.first).astype(np.uint64)
        r = 64 - self.q
        more, k, digits = np.zeros(len(at), np.uint64), 0, np.diff(np.r_[at, len(self.slots)]) - 1
        while (own := np.flatnonzero(digits > k)).size:
            more[own] |= self.slots[at[own] + 1 + k] << np.uint64(k * r)
            k += 1
        return (quotient << np.uint64(r)) | self.slots[at], more + np.uint64(1)

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of both multisets: two runs through sorted remainders, counts of equal ones added."""
        (f, n), (g, m) = self.items(), other.items()
        if not len(f) or not len(g):
            return self if len(f) else other
        at = np.searchsorted(f, g)
        same = f[np.minimum(at, len(f) - 1)] == g
        n[at[same]] += m[same]
        return self.encoded(np.insert(f, at[~same], g[~same]), np.insert(n, at[~same], m[~same]))

    @classmethod
    def all_merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Pair by pair, so that every fingerprint is moved once a level."""
        while len(filters) > 1:
            filters = [a.merged(b) if b else a for a, b in zip(filters[::2], [*filters[1::2], *[None] * (len(filters) % 2)], strict=True)]
        return filters[0] if filters else cls.of(np.zeros(0, np.uint64))

    def to_bytes(self) -> bytes:
        each = -(-(64 - self.q) // 8)
        bits = [np.packbits(x, bitorder="little").tobytes() for x in (self.occupied, self.runend, self.counter)]
        low = np.ascontiguousarray(self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :each])
        return b"".join([self.HEADER.pack(self.q, self.first, self.quotients, len(self.slots)), *bits, low.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, first, quotients, n = cls.HEADER.unpack_from(data)
        at, bits, each = cls.HEADER.size, [], -(-(64 - q) // 8)
        for size in (quotients, n, n):
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size, bitorder="little").astype(bool))
            at += -(-size // 8)
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :each] = np.frombuffer(data, np.uint8, n * each, at).reshape(n, each)
        return cls(q, first, quotients, *bits, slots.reshape(-1).view("<u8").astype(np.uint64))


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(None, SPACES)


def ranges(fingerprints: np.ndarray, parts: int) -> np.ndarray:
    """Bounds, in sorted fingerprints, of each of `parts` equal ranges of the upper 32 bits."""
    edge = np.array([-(-(p << 32) // parts) << 32 for p in range(1, parts)], np.uint64)
    return np.r_[0, np.searchsorted(fingerprints, edge), len(fingerprints)]


class Fingerprints:
    """A batch's texts without white space, and their fingerprints."""

    def __init__(self, row: dict, parts: int):
        self.texts = unpack(row)
        self.plain = [normalised(t) for t in self.texts]
        f = np.array([xxhash.xxh3_64_intdigest(t) for t in self.plain], np.uint64)
        self.distinct, self.of = np.unique(f, return_inverse=True)
        self.all = f
        self.bounds = ranges(self.distinct, parts)

    def rows(self, bid: int) -> dict:
        full = np.flatnonzero(np.diff(self.bounds)).tolist()
        f = np.sort(self.all)
        own = ranges(f, len(self.bounds) - 1)
        return {"part": full, "bid": [bid] * len(full), "filter": [CountingQuotientFilter.of(f[own[p] : own[p + 1]]).to_bytes() for p in full]}

    def repeated(self, part: list[int], bits: list[bytes]) -> list[bool]:
        """For each text: whether its fingerprint counts above one over all batches."""
        yes = np.zeros(len(self.distinct), bool)
        for p, b in zip(part, bits, strict=True):
            own = slice(self.bounds[p], self.bounds[p + 1])
            yes[own] = np.unpackbits(np.frombuffer(b, np.uint8), count=own.stop - own.start, bitorder="little")
        return yes[self.of].tolist()


def merge_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Answers (bid, part, bits) to the filters of each range: which fingerprints count above one in all."""
    by: dict[int, list[tuple[int, CountingQuotientFilter]]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            by.setdefault(r["part"], []).append((r["bid"], CountingQuotientFilter.from_bytes(r["filter"])))
    for part, own in by.items():
        f, n = CountingQuotientFilter.all_merged([x for _, x in own]).items()
        f = f[n > 1]
        for bid, x in own:
            yield {"bid": [bid], "part": [part], "bits": [np.packbits(np.isin(x.items()[0], f, assume_unique=True), bitorder="little").tobytes()]}


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Texts (sha, body) in order of sha: the first of each, after all others were found equal to it."""
    unpack_, last, first = zstandard.ZstdDecompressor(), None, b""
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for sha, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = unpack_.decompress(body)
            if sha != last:
                last, first = sha, data
                out[0].append(sha)
                out[1].append(body)
            elif first != data:
                raise RuntimeError("two texts share a SHA-256 and differ")
        yield {"sha": out[0], "body": out[1]}


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null counts as the empty text. Of equal texts the row with the most code points in the original
    stays, then the smallest doc_id, ids before null. Rows that repeat an id and its text share one
    decision. An empty table gives an empty result; further columns, of whatever name, aren't read.
    """
    src = texts(docs, id_col, text_col)
    kind, size = src.schema["doc_id"].dataType.simpleString(), input_bytes(src)
    parts, few = parts_for(size), parts_for(size // TEXT_A_FILTER_BYTE)
    salts = math.isqrt(4 * parts)  # copies of a hot text are compared in two steps, so that none has them all
    batches = packed(src, parts)

    def filters(rows: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in rows:
            for row in batch.to_pylist():
                yield Fingerprints(row, few).rows(row["bid"])

    def route(row: dict, part: list[int], bits: list[bytes]) -> dict:
        own, pack, sent = Fingerprints(row, few), zstandard.ZstdCompressor(1), set()
        suspect = own.repeated(part, bits)
        shas = [hashlib.sha256(t).digest() for t in own.plain]
        bodies = []
        for sha, t, hit in zip(shas, own.plain, suspect, strict=True):
            new = hit and sha not in sent
            bodies.append(pack.compress(t) if new else None)
            if new:
                sent.add(sha)
        return {"doc_id": row["ids"], "sha": shas, "size": [len(t.decode()) for t in own.texts], "suspect": suspect, "salt": [row["bid"] % salts] * len(shas), "body": bodies}

    sent = arrow_map(batches, filters, FILTER).repartitionById(few, F.col("part"))
    told = arrow_map(sent, merge_filters, ANSWER)
    routed = save(with_answers(batches, told, route, f"doc_id {kind}, sha binary, size long, suspect boolean, salt long, body binary"))
    bodies = routed.where("body is not null").select("sha", "body", "salt").repartition("sha", "salt").sortWithinPartitions("sha", "salt")
    some = arrow_map(bodies, verify, "sha binary, body binary").repartition("sha").sortWithinPartitions("sha")
    same = arrow_map(some, verify, "sha binary, body binary").select("sha")
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")))
    groups = save(routed.where("suspect").groupBy("sha").agg(best.alias("best"), F.count("*").alias("n")).join(same, "sha"))  # of its own, so that the next join may split a hot group
    several = routed.where("suspect").join(groups, "sha").select("doc_id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), "sha")
    alone = routed.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return alone.unionByName(several).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
