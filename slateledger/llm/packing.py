"""Sequence packing: minimum bin slack by bitset subset-sum dynamic programming over token lengths."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from slateledger.llm.common import arrow_map, table, texts

CAPACITY = 1024
#: Remainders held after windows were filled; twice as many are held before. What fills no window exactly is cut.
POOL = 8192
#: Words whose ids a task remembers; the memory is emptied when it is full, which changes no result.
REMEMBERED = 800_000
#: Fixed value: the byte-level tokenizer's word bounds.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = b"\0\0\0\0"

#: Texts for which a split at single spaces and line ends gives the tokenizer's own word bounds.
_PLAIN = re.compile("(?:[!-~À-ÖØ-öø-ſ]++(?: (?=[^ \\n])|\\n(?=[^ \\n])|\\Z))*+")


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file; the installed byte-level BPE unless another path is given."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Tokens as bytes, by id, if the file's merges are made in the order of the ids; else None."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    as_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    ranks = {bytes(map(as_byte.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in as_byte for c in t)}
    pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    return ranks if [model["vocab"].get(x) for x in pairs] == list(range(256, 256 + len(pairs))) else None


class Encoder:
    """Token ids as little-endian bytes of 32 bits each, equal to the library's, words remembered.

    New words are merged by rank over the same vocabulary, which takes a fifth of the library's time a
    word; texts that aren't plain go through the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.first, self.spaced = Tokenizer.from_file(path), {}, {}
        self.newline, self.ranked, ranks = self.whole("\n"), None, byte_ranks(path)
        if ranks:
            import tiktoken

            self.ranked = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.lib.encode(text, add_special_tokens=False).ids)

    def learn(self, known: dict[str, bytes], words: set[str], lead: str) -> None:
        new = [w for w in words if w not in known]
        if self.ranked:
            for w in new:
                known[w] = array("I", self.ranked(lead + w)).tobytes()
        else:
            for w, e in zip(new, self.lib.encode_batch([lead + w for w in new], add_special_tokens=False), strict=True):
                known[w] = self.packed(e.ids)

    def encode(self, texts_: list[str]) -> Iterator[bytes]:
        """The ids of each text without the terminator."""
        if len(self.first) + len(self.spaced) > REMEMBERED:
            self.first, self.spaced = {}, {}
        for text in texts_:
            m = _PLAIN.match(text) if text and "<|" not in text else None
            if not text:
                yield b""
            elif m is None or m.end() < len(text):
                yield self.whole(text)
            else:
                lines = [x.split(" ") for x in text.split("\n")]
                self.learn(self.first, {x[0] for x in lines}, "")
                self.learn(self.spaced, {w for x in lines for w in x[1:]}, " ")
                out: list[bytes] = []
                for x in lines:
                    out += (self.newline, self.first[x[0]], *map(self.spaced.__getitem__, x[1:]))
                yield b"".join(out[1:])


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths whose sum is closest to room from below, as (length, how often).

    Reachable sums are the bits of an integer; each length is added in binary shares of its count, and
    the integers before each share let the choice be traced back. Stops as soon as room is reached.
    """
    full, sums, trail = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room or not counts[n]:
            continue
        left, share = min(counts[n], room // n), 1
        while left:
            k = min(share, left)
            trail.append((sums, n, k))
            sums |= (sums << (n * k)) & full
            left, share = left - k, share * 2
            if sums >> room & 1:
                break
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, {}
    for before, n, k in reversed(trail):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + k
            at -= n * k
    return list(out.items())


class Packer:
    """Fills windows from the remainders of one task. A remainder: (doc, start, ids, doc_tokens)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.by_length, self.held, self.rows, self.next = capacity, {}, 0, [], 0

    def put(self, window: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, size = len(ids) // 4, self.capacity * 4
        for k in range(0, len(ids) - size + 1, size):
            self.put([(doc, k // 4, ids[k : k + size], total)])
        if rest := total % self.capacity:
            start = total - rest
            self.by_length.setdefault(rest, []).append((doc, start, ids[start * 4 :], total))
            self.held += 1

    def fill(self, keep: int) -> None:
        """Windows by minimum slack, each opened by the longest remainder, while more than keep are held.

        What fills no window exactly is cut to full windows; less than a window of it is held on, or cut
        to powers of two where nothing is kept. So no more than keep and a window's remainders stay.
        """
        lengths = sorted(self.by_length, reverse=True)
        counts = {n: len(x) for n, x in self.by_length.items()}
        under: list[tuple] = []
        while self.held > keep:
            while lengths and not counts[lengths[0]]:
                lengths.pop(0)
            seed = lengths[0]
            counts[seed] -= 1
            chosen = {seed: 1}
            for n, k in best_fill(counts, lengths, self.capacity - seed):
                chosen[n] = chosen.get(n, 0) + k
            counts[seed] += 1
            full = sum(n * k for n, k in chosen.items()) == self.capacity
            times = min(counts[n] // k for n, k in chosen.items()) if full else 1
            for n, k in chosen.items():
                counts[n] -= k * times
            self.held -= times * sum(chosen.values())
            for _ in range(times):
                window = [self.by_length[n].pop() for n, k in chosen.items() for _ in range(k)]
                if full:
                    self.put(window)
                else:
                    under += window
        self.by_length = {n: x for n, x in self.by_length.items() if x}
        for x in self.cut(under, last=not keep):
            self.by_length.setdefault(len(x[2]) // 4, []).append(x)
            self.held += 1

    def cut(self, pieces: list[tuple], last: bool) -> list[tuple]:
        """Windows filled by cutting; less than a window is given back, or the last are cut to powers of two."""
        left, total = list(reversed(pieces)), sum(len(x[2]) // 4 for x in pieces)
        while left and (last or total >= self.capacity):
            room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            total -= room
            window = []
            while room:
                doc, start, ids, all_ = left.pop()
                n = len(ids) // 4
                if n > room:
                    left.append((doc, start + room, ids[room * 4 :], all_))
                    ids, n = ids[: room * 4], room
                window.append((doc, start, ids, all_))
                room -= n
            self.put(window)
        return left

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and a terminating 0; a null or empty text is the terminator alone. Repeated
    rows are packed once each, a null id is carried along; documents of one length that divides no window
    are cut. Every task packs its own documents, holding at most 2 * POOL remainders and those of a window;
    sequence_id is unique over all tasks. capacity is a power of two. An empty table gives an empty result.
    """
    src, path = texts(docs, id_col, text_col), vocabulary(tokenizer)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, packer = Encoder(path), Packer(capacity)
        first = TaskContext.get().partitionId() << 40

        def out() -> dict:
            cols = [list(x) for x in zip(*packer.take(), strict=True)] or [[] for _ in names]
            cols[5] = [first + x for x in cols[5]]
            return dict(zip(names, cols, strict=True))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k in range(0, len(ids), 512):
                for doc, tokens in zip(ids[k : k + 512], encoder.encode([t or "" for t in batch.column(1).slice(k, 512).to_pylist()]), strict=True):
                    packer.add(doc, tokens + END)
                    if packer.held > 2 * POOL:
                        packer.fill(POOL)
                yield out()
        packer.fill(0)
        yield out()

    kind = src.schema["doc_id"].dataType.simpleString()
    return arrow_map(src, pack, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark, sf_dir):
    return pack_sequences(table(spark, sf_dir, "documents"))
