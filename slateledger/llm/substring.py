"""Repeated passages of words: a count-min prefilter, then exact groups of the windows left.

Every batch of documents makes a sparse count-min sketch of its windows of WINDOW words: the cells that
they touch, in ROWS_OF_COUNTERS rows, with how often. The table is cut into slices, one for each part;
a part's task adds up what all batches have in its slice and tells each batch which of its cells are above
one. Windows all of whose cells are have an estimate above one and go to the second pass, where they
are grouped by 128 bits of the SHA-256 of their words. An estimate is never below a window's count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateledger.llm.common import arrow_map, as_bytes, input_bytes, mix, parts_for, table, texts
from slateledger.llm.exchange import ANSWER, ASK, Ask, count_keys, packed, unpack, with_answers

WINDOW = 35
ROWS_OF_COUNTERS = 2
#: Counters of one slice in each row; the table has a slice for each part, so that its width follows the
#: input (some eight counters a window).
SLICE_BITS = 25
SKETCH = "part int, bid long, row int, cells binary, more binary"


class Sketch:
    """A batch's sparse count-min sketch: its distinct cells in each row and slice, and which occur more than once."""

    def __init__(self, windows: np.ndarray, parts: int, bits: int = SLICE_BITS):
        self.parts, self.bits, cells = parts, bits, []
        for r in range(ROWS_OF_COUNTERS):
            h = mix(windows, 11 + r)
            cells.append(((h % np.uint64(parts) + np.uint64(r * parts)) << np.uint64(bits)) | (h >> np.uint64(64 - bits)))
        flat = np.concatenate(cells)
        order = np.argsort(flat)
        cell = flat[order]
        new = np.r_[np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1]]
        start = np.flatnonzero(new)
        self.of = np.empty(len(flat), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.cell, self.more = cell[start], np.diff(np.r_[start, len(cell)]) > 1
        self.bounds = np.searchsorted(self.cell >> np.uint64(bits), np.arange(ROWS_OF_COUNTERS * parts + 1, dtype=np.uint64))

    def rows(self, bid: int) -> dict:
        """Cells as differences, byte plane by byte plane, which a shuffle's compression makes short."""
        full = np.flatnonzero(np.diff(self.bounds)).tolist()
        own = [slice(self.bounds[p], self.bounds[p + 1]) for p in full]
        low = (self.cell & np.uint64((1 << self.bits) - 1)).astype(np.uint32)
        return {
            "part": [p % self.parts for p in full], "bid": [bid] * len(full), "row": [p // self.parts for p in full],
            "cells": [np.ascontiguousarray(np.diff(low[s], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes() for s in own],
            "more": [np.packbits(self.more[s], bitorder="little").tobytes() for s in own],
        }

    def repeated(self, part: list[int], bits: list[bytes]) -> np.ndarray:
        """Whether each window's estimate is above one; part is that of the slice, row by row."""
        yes = np.zeros(len(self.cell), bool)
        for p, b in zip(part, bits, strict=True):
            own = slice(self.bounds[p], self.bounds[p + 1])
            yes[own] = np.unpackbits(np.frombuffer(b, np.uint8), count=own.stop - own.start, bitorder="little")
        return np.logical_and.reduce(yes[self.of].reshape(ROWS_OF_COUNTERS, -1), axis=0)


class Counters:
    """One slice of one row of the table; sketches are added cell by cell, counts stay at 255 beyond it."""

    def __init__(self, bits: int = SLICE_BITS):
        self.n = np.zeros(1 << bits, np.uint8)

    @staticmethod
    def read(cells: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
        diff = np.ascontiguousarray(np.frombuffer(cells, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0]
        return np.cumsum(diff, dtype=np.uint32), np.unpackbits(np.frombuffer(more, np.uint8), count=len(diff), bitorder="little")

    def add(self, cells: bytes, more: bytes) -> None:
        at, twice = self.read(cells, more)
        had = self.n[at]
        self.n[at] = had + np.minimum(1 + twice, 255 - had)

    def above_one(self, cells: bytes, more: bytes) -> bytes:
        return np.packbits(self.n[self.read(cells, more)[0]] > 1, bitorder="little").tobytes()


def add_sketches(parts: int):
    """Answers (bid, part of the row and slice, bits) to all batches with cells in this slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = [r for b in batches for r in b.to_pylist()]
        for k in range(ROWS_OF_COUNTERS):
            for p in sorted({r["part"] for r in rows}):
                own, table_ = [r for r in rows if r["row"] == k and r["part"] == p], Counters()
                for r in own:
                    table_.add(r["cells"], r["more"])
                yield {"bid": [r["bid"] for r in own], "part": [k * parts + p] * len(own), "bits": [table_.above_one(r["cells"], r["more"]) for r in own]}

    return run


_B1 = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done, step = 1, base
    with np.errstate(over="ignore"):
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * np.uint64(step)
            done, step = done + k, step * step % 2**64
    return out


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all runs of `size` values, mixed. Equal runs have equal hashes; unequal ones may,
    so that nothing but a prefilter may rest on them."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(_B1, len(values)), out=prefix[1:])
        return mix((prefix[size:] - prefix[:-size]) * _powers(pow(_B1, -1, 2**64), len(values))[: len(values) - size + 1])


class Words:
    """A batch of documents as one buffer of words joined by spaces, with an array of word hashes."""

    def __init__(self, docs: list[bytes]):
        number: dict[bytes, int] = {}
        get, ids, joined = number.setdefault, [], []
        for d in docs:
            ws = d.split()
            ids.append(np.fromiter((get(w, len(number)) for w in ws), np.int32, len(ws)))
            if ws:
                joined.append(b" ".join(ws))
        self.lens = np.array(list(map(len, ids)), np.int64)
        self.begin = np.r_[0, np.cumsum(self.lens)]
        self.text, at = b" ".join(joined), np.concatenate(ids) if ids else np.zeros(0, np.int32)
        h = xxhash.xxh3_64_intdigest
        self.hash = np.array([h(w) for w in number], np.uint64)[at]
        size = np.array(list(map(len, number)), np.int64)[at]
        self.to = np.cumsum(size + 1) - 1  # where each word ends in the buffer
        self.from_ = self.to - size

    def windows(self, size: int) -> np.ndarray:
        """Starts of all windows of `size` words within one document."""
        left = np.repeat(self.begin[1:], self.lens) - np.arange(len(self.hash))
        return np.flatnonzero(left >= size)

    def digests(self, starts: np.ndarray, size: int) -> np.ndarray:
        """128 bits of the SHA-256 of each window's words, as two numbers."""
        view, sha = memoryview(self.text), hashlib.sha256
        spans = zip(self.from_[starts].tolist(), self.to[starts + size - 1].tolist(), strict=True)
        return np.frombuffer(b"".join([sha(view[a:b]).digest()[:16] for a, b in spans]), np.uint64).reshape(-1, 2)

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """Each document's words that aren't gone, joined by one space."""
        out = []
        for a, b in zip(self.begin[:-1].tolist(), self.begin[1:].tolist(), strict=True):
            g = gone[a:b]
            if g.any():
                turn = np.flatnonzero(np.diff(np.r_[True, g, True])) + a
                out.append(b" ".join([self.text[self.from_[s] : self.to[e - 1]] for s, e in turn.reshape(-1, 2).tolist()]))
            else:
                out.append(self.text[self.from_[a] : self.to[b - 1]] if b > a else b"")
        return out


def cover(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n items lie in a window of `size` items at one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:-1] > 0


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its words left, joined by one space).

    A null or empty text has no words, and texts of fewer words than a window lose nothing. Repeated
    rows are documents of their own, so each repeats the other. An empty table gives an empty result.
    """
    src = texts(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    parts = parts_for(input_bytes(src))
    batches = packed(src, parts)

    def sketched(row: dict) -> tuple[Words, np.ndarray, Sketch]:
        w = Words(unpack(row))
        starts = w.windows(window)
        return w, starts, Sketch(rolling(w.hash, window)[starts] if len(starts) else np.zeros(0, np.uint64), parts)

    def ask_sketch(rows: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in rows:
            for row in b.to_pylist():
                yield sketched(row)[2].rows(row["bid"])

    def candidates(row: dict, part: list[int], bits: list[bytes]) -> tuple[Words, np.ndarray, Ask]:
        """The windows that the sketch estimates repeated."""
        w, starts, sketch = sketched(row)
        starts = starts[sketch.repeated(part, bits)]
        key = w.digests(starts, window)
        return w, starts, Ask(key[:, 0], parts, key[:, 1])

    def ask_windows(row: dict, part: list[int], bits: list[bytes]) -> dict:
        return candidates(row, part, bits)[2].rows(row["bid"])

    def finish(row: dict, part: list[int], bits: list[bytes]) -> dict:
        pick = lambda second: ([-1 - p if second else p for p in part if (p < 0) == second], [b for p, b in zip(part, bits, strict=True) if (p < 0) == second])
        w, starts, ask = candidates(row, *pick(False))
        gone = cover(len(w.hash), starts[ask.answer(*pick(True))[0]], window)
        removed = np.diff(np.r_[0, np.cumsum(gone, dtype=np.int64)][w.begin])
        return {"doc_id": row["ids"], "n_words": w.lens, "n_removed": removed, "kept": [x.decode() for x in w.kept(gone)]}

    asked = arrow_map(batches, ask_sketch, SKETCH).repartitionById(parts, F.col("part"))
    estimated = arrow_map(asked, add_sketches(parts), ANSWER)
    exact = with_answers(batches, estimated, ask_windows, ASK).repartitionById(parts, F.col("part"))
    grouped = arrow_map(exact, count_keys(2), ANSWER)
    answers = estimated.unionByName(grouped.withColumn("part", -1 - F.col("part")))
    return with_answers(batches, answers, finish, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark, sf_dir):
    found = repeated_passages(table(spark, sf_dir, "documents"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b.column(0), "n_words": b.column(1), "n_removed": b.column(2), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in as_bytes(b.column(3))]}

    return arrow_map(found, digest, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, hash(array_to_string(w[k:k + 34], ' ')) AS h, md5(array_to_string(w[k:k + 34], ' ')) AS m
      FROM d, unnest(range(1, len(w) - 33)) t(k)),
r AS (SELECT doc_id, k FROM g WHERE (h, m) IN (SELECT (h, m) FROM g GROUP BY h, m HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, k + j AS p FROM r, unnest(range(35)) u(j)),
n AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)], ' '), '') END) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""
