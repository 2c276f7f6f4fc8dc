"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most 2 bits, cut into 2 segments of 32 bits, have a
segment in which they differ in at most 1 bit. Each segment is indexed under its 32 one-wildcard
variants (the segment with one bit deleted), so such a pair meets under an equal key, where it is
verified in full. Only distinct fingerprints are indexed: copies cost nothing. Keys that too many
fingerprints share are cut once more, by the pieces of the other segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateledger.llm.common import arrow_map, as_bytes, blocks, mix, parts_for, runs, save, texts
from slateledger.llm.components import components, local_roots

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 2
SEGMENTS, SEGMENT_BITS = 2, 32
#: A variant of too many fingerprints is indexed under one of these pieces (shift, width) of the other segment, too:
#: of three, one is equal if at most 2 bits differ. Such a key has 2 ** 23 fingerprints at most.
PIECES = ((0, 11), (11, 11), (22, 10))
#: Fingerprints from which on a counter's keys are cut into pieces (or eight times the mean, where that is more).
HOT = 1 << 16
#: Keys are counted by hash in at most 2 ** this counters; collisions only cut more keys.
MOST_COUNTER_BITS = 22
#: Runs of equal keys up to this length are compared by shifting, longer ones by their neighbours.
SHIFT_RUN = 256
#: Neighbours sorted at once.
RUN_ROOM = 1 << 22


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; the whole sequence where words are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, SEED)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: 1 - size].tolist()
    return np.array([h(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the hashes; no words: zero."""
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(np.ascontiguousarray(h[k : k + (1 << 16)]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def variant_keys(fp: np.ndarray, v: int) -> np.ndarray:
    """Key v of each fingerprint: below 64 segment v // 32 without its bit v % 32, and v above it; beyond,
    variant (v - 64) // 3 together with a piece of the other segment."""
    variant, piece = (v, None) if v < BITS else divmod(v - BITS, len(PIECES))
    segment = variant // SEGMENT_BITS
    seg = (fp >> np.uint64(SEGMENT_BITS * segment)) & np.uint64(0xFFFFFFFF)
    key = (seg & ~np.uint64(1 << (variant % SEGMENT_BITS))) | np.uint64(variant << SEGMENT_BITS)
    if piece is None:
        return key
    shift, width = PIECES[piece]
    other = (fp >> np.uint64(SEGMENT_BITS * (1 - segment) + shift)) & np.uint64((1 << width) - 1)
    return key | np.uint64((piece + 1) << 38) | (other << np.uint64(40))


def _near_in_run(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in one long run: two fingerprints differ in at most 2 bits if and only if they have a common
    neighbour, a number that differs from each in at most 1; so those with a neighbour are linked to its first."""
    a, b, slices = [np.arange(len(fp))], [np.arange(len(fp))], -(-len(fp) * (BITS + 1) // RUN_ROOM)
    flips = np.r_[np.zeros(1, np.uint64), np.uint64(1) << np.arange(BITS, dtype=np.uint64)]
    for s in range(slices):
        near, own = [], []
        for flip in flips:
            z = fp ^ flip
            at = np.flatnonzero(mix(z, 5) % np.uint64(slices) == np.uint64(s)) if slices > 1 else a[0]
            near.append(z[at])
            own.append(at)
        z, at = np.concatenate(near), np.concatenate(own)
        order = np.argsort(z, kind="stable")
        start, length = runs(z[order])
        a.append(at[order])
        b.append(np.repeat(at[order][start], length))
        root = local_roots(len(fp), np.concatenate(a), np.concatenate(b))
        a, b = a[:1], [root]
    return a[0], b[0]


def near_links(v: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest fingerprint reachable here) among entries that share a key."""
    key = np.zeros(len(fp), np.uint64)
    for k in np.unique(v).tolist():
        at = v == k
        key[at] = variant_keys(fp[at], k)
    order = np.argsort(key, kind="stable")
    key, f = key[order], fp[order]
    start, length = runs(key)
    a, b = [], []
    for s, n in zip(start[length > SHIFT_RUN], length[length > SHIFT_RUN], strict=True):
        i, j = _near_in_run(f[s : s + n])
        a.append(f[s + i])
        b.append(f[s + j])
    small = np.repeat(length <= SHIFT_RUN, length)
    at = np.flatnonzero(small)
    for d in range(1, SHIFT_RUN):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        hit = at[np.bitwise_count(f[at] ^ f[at + d]) <= DISTANCE]
        a.append(f[hit])
        b.append(f[hit + d])
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    nodes, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    half = len(at) // 2
    root = local_roots(len(nodes), at[:half], at[half:])
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def hot_counters(fingerprints: DataFrame, n: int) -> tuple[bytes, int]:
    """A bitmap of the counters with too many keys, and its width in bits: 512 KB at most."""
    spark, bits = fingerprints.sparkSession, min(MOST_COUNTER_BITS, max(10, (4 * n).bit_length()))
    slice_bits, limit = min(bits, 16), max(HOT, 8 * BITS * n >> bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for v in range(BITS):
                np.add(total, np.bincount(counter(variant_keys(fp, v), bits), minlength=1 << bits), out=total, casting="unsafe")
        own = total.reshape(-1, 1 << slice_bits)
        full = np.flatnonzero(own.any(axis=1)).tolist()
        yield {"slice": full, "n": [own[k].tobytes() for k in full]}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(data, np.uint32).astype(np.int64)
        for k, x in total.items():
            if (x > limit).any():
                yield {"slice": [k], "bits": [np.packbits(x > limit, bitorder="little").tobytes()]}

    slices = 1 << (bits - slice_bits)
    counted = arrow_map(fingerprints, count, "slice int, n binary").repartitionById(slices, F.col("slice"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for k, data in arrow_map(counted, add, "slice int, bits binary").toLocalIterator():
        size = (1 << slice_bits) // 8
        out[k * size : (k + 1) * size] = np.frombuffer(data, np.uint8)
    return out.tobytes(), bits


def counter(key: np.ndarray, bits: int) -> np.ndarray:
    return (mix(key, 3) >> np.uint64(64 - bits)).astype(np.int64)


def scattered(fp: np.ndarray, parts: int, hot: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, v, fp) for every key under which a fingerprint is indexed."""
    part, every_v, every_fp = [], [], []

    def put(v: int, key: np.ndarray, own: np.ndarray) -> None:
        part.append((mix(key) % np.uint64(parts)).astype(np.int32))
        every_v.append(np.full(len(own), v, np.uint16))
        every_fp.append(own)

    for v in range(BITS):
        key = variant_keys(fp, v)
        cut = hot[counter(key, bits)]
        put(v, key[~cut], fp[~cut])
        if cut.any():
            for k in range(BITS + v * len(PIECES), BITS + (v + 1) * len(PIECES)):
                put(k, variant_keys(fp[cut], k), fp[cut])
    return np.concatenate(part), np.concatenate(every_v), np.concatenate(every_fp)


def simhash_links(fingerprints: DataFrame, n: int, parts: int) -> DataFrame:
    """n distinct fingerprints (fp) -> links (a, b) that connect all within DISTANCE bits of each other."""
    bitmap, bits = hot_counters(fingerprints, n)
    shared = fingerprints.sparkSession.sparkContext.broadcast(bitmap)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hot = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").astype(bool)
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.asarray(batch.column(0)).view(np.uint64))
            if sum(map(len, held)) >= 1 << 17:
                yield out(np.concatenate(held), hot)
                held = []
        if held:
            yield out(np.concatenate(held), hot)

    def out(fp: np.ndarray, hot: np.ndarray) -> dict:
        part, v, own = scattered(fp, parts, hot, bits)
        order, at = blocks(part, parts)
        v, own = v[order], own[order]
        full = [p for p in range(parts) if at[p + 1] > at[p]]
        return {"part": full, "v": [v[at[p] : at[p + 1]].tobytes() for p in full], "fp": [own[at[p] : at[p + 1]].tobytes() for p in full]}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        v, fp = [], []
        for batch in batches:
            v += batch.column(1).to_pylist()
            fp += batch.column(2).to_pylist()
        if v:
            a, b = near_links(np.frombuffer(b"".join(v), np.uint16), np.frombuffer(b"".join(fp), np.uint64))
            yield {"a": a.view(np.int64), "b": b.view(np.int64)}

    sent = arrow_map(fingerprints, scatter, "part int, v binary, fp binary")
    return arrow_map(sent.repartitionById(parts, F.col("part")), meet, "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    A null or empty text has fingerprint zero and is linked like any other. Repeated rows give
    repeated result rows; rows without an id have the component of their fingerprint but link nothing by
    themselves. component_id is the smallest
    doc_id reachable over links of at most 2 differing bits. An empty table gives an empty result.
    """
    src = texts(docs, id_col, text_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch.column(0), "fp": np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)}

    signed = save(arrow_map(src, sign, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long"))
    firsts = save(signed.groupBy("fp").agg(F.min("doc_id").alias("node")))
    n = firsts.count()
    links = simhash_links(firsts.select("fp"), n, parts_for(n * BITS * 10, 24 << 20))
    as_nodes = links.join(firsts.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    labels = firsts.join(components(as_nodes), "node", "left").select("fp", F.coalesce("component_id", "node").alias("component_id"))
    return signed.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir):
    from slateledger.llm.common import table

    return simhash_dedup(table(spark, sf_dir, "documents"))
