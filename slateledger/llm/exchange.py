"""Questions from batches of documents to tasks that hold a share of all keys, and the answers back.

A batch is one row of compressed text, dealt once by its number. Its questions are rows (part, bid, keys);
a part's task sees the questions of all batches for its keys and answers each with bits; the answers meet
their batch again by bid. So nothing is looked up by document, no table of answers is broadcast, and a
key that half of all documents have is one entry of each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from slateledger.llm.common import arrow_map, arrow_schema, as_bytes, blocks, mix, save, ship

#: Text of one packed batch; a longer document is a batch of its own.
BATCH_BYTES = 2 << 20
ASK = "part int, bid long, keys binary, tags binary, counts binary"
ANSWER = "bid long, part int, bits binary"


def packed(src: DataFrame, parts: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Documents in batches: one row (bid, ids, lens, body) of compressed text; a null text has length -1.
    bid is set by the input's own partitions and order, which a lost task's second run may change; so the batches
    are written before anything is asked in their name, and dealt by bid so that later steps find them there."""
    kind = src.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        z, bid, ids, held, size = zstandard.ZstdCompressor(1), TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> dict:
            lens = np.array([-1 if x is None else len(x) for x in held], np.int64)
            return {"bid": [bid], "ids": [ids], "lens": [lens.tobytes()], "body": [z.compress(b"".join(x or b"" for x in held))]}

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids.append(doc)
                held.append(text)
                size += len(text or b"") + 32
                if size >= batch_bytes:
                    yield row()
                    bid, ids, held, size = bid + 1, [], [], 0
        if ids:
            yield row()

    return save(arrow_map(src, pack, f"bid long, ids array<{kind}>, lens binary, body binary"), compression="none").repartition(parts, "bid")


def unpack(row: dict) -> list[bytes]:
    """A batch's texts; null ones are empty."""
    body, out, at = zstandard.ZstdDecompressor().decompress(row["body"]), [], 0
    for n in np.maximum(0, np.frombuffer(row["lens"], np.int64)).tolist():
        out.append(body[at : at + n])
        at += n
    return out


class Ask:
    """A batch's distinct keys (with tags, where one key of 64 bits isn't all) dealt to parts, in an order
    that the answer's bits follow."""

    def __init__(self, keys: np.ndarray, parts: int, tags: np.ndarray | None = None):
        self.order = np.argsort(keys, kind="stable") if tags is None else np.lexsort((tags, keys))
        k = keys[self.order]
        new = k[1:] != k[:-1]
        if tags is not None:
            t = tags[self.order]
            new |= t[1:] != t[:-1]
        self.start = np.flatnonzero(np.r_[np.ones(min(1, len(k)), bool), new])
        self.length = np.diff(np.r_[self.start, len(k)])
        self.keys, self.tags = k[self.start], None if tags is None else t[self.start]
        self.deal, self.bounds = blocks((mix(self.keys, 7) % np.uint64(parts)).astype(np.int32), parts)
        self.full = np.flatnonzero(np.diff(self.bounds)).tolist()

    def cut(self, x: np.ndarray | None) -> list[bytes]:
        return [b"" if x is None else x[self.deal[self.bounds[p] : self.bounds[p + 1]]].tobytes() for p in self.full]

    def rows(self, bid: int) -> dict:
        return {"part": self.full, "bid": [bid] * len(self.full), "keys": self.cut(self.keys), "tags": self.cut(self.tags), "counts": self.cut(self.length.astype(np.uint32))}

    def answer(self, part: list[int], bits: list[bytes], planes: int = 1) -> list[np.ndarray]:
        """For every key as given, plane by plane of the answers."""
        yes = np.zeros((planes, len(self.keys)), bool)
        for p, b in zip(part, bits, strict=True):
            at = self.deal[self.bounds[p] : self.bounds[p + 1]]
            yes[:, at] = np.unpackbits(np.frombuffer(b, np.uint8), count=planes * len(at), bitorder="little").reshape(planes, -1)
        out = np.zeros((planes, len(self.order)), bool)
        out[:, self.order] = np.repeat(yes, self.length, axis=1)
        return list(out)


def counted(keys: list[bytes], tags: list[bytes], counts: list[bytes]) -> list[np.ndarray]:
    """For the keys of each question: how often each occurs in all of them."""
    k, t = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(tags), np.uint64)
    order = np.lexsort((t, k)) if len(t) else np.argsort(k, kind="stable")
    new = np.r_[np.ones(min(1, len(k)), bool), k[order][1:] != k[order][:-1]]
    if len(t):
        new[1:] |= t[order][1:] != t[order][:-1]
    start = np.flatnonzero(new)
    total = np.zeros(len(k), np.int64)
    if len(k):
        sums = np.add.reduceat(np.frombuffer(b"".join(counts), np.uint32)[order].astype(np.int64), start)
        total[order] = np.repeat(sums, np.diff(np.r_[start, len(k)]))
    return np.split(total, np.cumsum([len(x) // 8 for x in keys])[:-1]) if keys else []


def count_keys(*least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]:
    """Answers with one plane of bits for each bound: whether a key occurs at least so often in all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = [r for b in batches for r in b.to_pylist()]
        totals = counted([r["keys"] for r in rows], [r["tags"] for r in rows], [r["counts"] for r in rows])
        bits = [np.packbits(np.concatenate([n >= x for x in least]), bitorder="little").tobytes() for n in totals]
        yield {"bid": [r["bid"] for r in rows], "part": [r["part"] for r in rows], "bits": bits}

    return run


def with_answers(batches: DataFrame, answers: DataFrame, fn: Callable[[dict, list[int], list[bytes]], dict], schema: str) -> DataFrame:
    """fn(row, part, bits) for every batch with its answers; the batches aren't moved again."""
    ship(batches.sparkSession)
    kinds = arrow_schema(batches.sparkSession, schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out, parts, bits = [], right.column("part").to_pylist(), right.column("bits").to_pylist()
        for row in left.to_pylist():
            cols = fn(row, parts, bits)
            out.append(pa.Table.from_arrays([pa.array(cols[f.name], type=f.type) for f in kinds], schema=kinds))
        return pa.concat_tables(out) if out else kinds.empty_table()

    return batches.groupBy("bid").cogroup(answers.groupBy("bid")).applyInArrow(both, schema)


