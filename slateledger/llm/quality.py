"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded, gated attention learned
from the documents' labels weighs them, and the weighted mean of the encodings is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateledger.llm.common import arrow_map, as_bytes, table
from slateledger.llm.labelled import sample

#: At most so many labelled rows are used for fitting (and labelled.MOST_BYTES of their text).
MOST_LABELLED = 8_000
#: A step of fitting takes whole bags of about so many passages in all.
STEP_PASSAGES = 1024
#: Bytes of a passage; all of a text is in one.
PASSAGE = 512
HIDDEN, ATTENTION = 24, 12

#: Classes of bytes: space, line end, lower, upper, digit, stop, other sign (four kinds), non-ASCII.
_CLASSES = np.full(256, 11, np.int16)
for _k, _chars in enumerate((b" \t\v\f", b"\n\r", bytes(range(0x61, 0x7B)), bytes(range(0x41, 0x5B)), b"0123456789", b".,;:'", b"!", b"$&", b"%#", b"*=_~|", b"()[]{}<>/\\@+-\"?")):
    for _c in _chars:
        _CLASSES[_c] = _k
_CLASSES[0x80:] = 2  # letters of the texts' languages
N = 12
#: Besides transitions, of the passage alone: share in use, distinct words and lines, their lengths.
EXTRA = 6
SIZE = N * N + EXTRA


def encode(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages, and where each text's passages begin; an empty text has one empty passage.

    Every number is of its passage alone, so that what a document scores goes through the attention.
    """
    texts = [t or b"" for t in texts]
    lens = np.array(list(map(len, texts)), np.int64)
    bags = np.maximum(1, -(-lens // PASSAGE))
    begin = np.r_[0, np.cumsum(bags)]
    c = _CLASSES[np.frombuffer(b"".join(texts), np.uint8)]
    place = np.arange(len(c)) - np.repeat(np.r_[0, np.cumsum(lens)[:-1]], lens)
    passage = np.repeat(begin[:-1], lens) + place // PASSAGE
    total = int(begin[-1])
    x = np.zeros((total, SIZE))
    if len(c):
        pair = passage[1:] * (N * N) + c[:-1] * N + c[1:]
        same = passage[1:] == passage[:-1]
        x[:, : N * N] = np.bincount(pair[same], minlength=total * N * N).reshape(total, N * N)
    used = np.bincount(passage, minlength=total)
    x[:, : N * N] = np.sqrt(x[:, : N * N] / np.maximum(1, used)[:, None])
    x[:, N * N] = used / PASSAGE
    row = 0
    for t in texts:
        for k in range(0, max(1, len(t)), PASSAGE):
            own = t[k : k + PASSAGE]
            if words := own.split():
                lines = [y for y in own.split(b"\n") if y]
                n = len(words)
                x[row, N * N + 1 :] = len(set(words)) / n, len(set(lines)) / max(1, len(lines)), np.log1p(n), (len(own) - n) / n / 10, np.log1p(n / max(1, len(lines)))
            row += 1
    return x, begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionMIL:
    """Gated attention over a bag's encoded passages; fitted by Adam on whole bags."""

    def __init__(self, size: int = SIZE, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"W": init(size, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION, 1), "o": init(HIDDEN, 1), "c": np.zeros(1)}
        self.mean, self.scale, self.prior = np.zeros(size), np.ones(size), 0.5

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple:
        p, start = self.p, begin[:-1]
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = ((v * u) @ p["w"])[:, 0]
        bag = np.repeat(np.arange(len(start)), np.diff(begin))
        e = np.exp(a - np.maximum.reduceat(a, start)[bag])
        weight = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(h * weight[:, None], start)
        return h, v, u, weight, bag, z, _sigmoid((z @ p["o"] + p["c"])[:, 0])

    def gradient(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict:
        p = self.p
        h, v, u, weight, bag, z, s = self.forward(x, begin)
        d = (s - y)[:, None] / len(y)
        dz = d @ p["o"].T
        dh = dz[bag] * weight[:, None]
        dw = (dz[bag] * h).sum(axis=1)
        da = weight * (dw - np.add.reduceat(weight * dw, begin[:-1])[bag])
        dv, du = da[:, None] * p["w"].T * u * (1 - v**2), da[:, None] * p["w"].T * v * u * (1 - u)
        dh = (dh + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ da[:, None], "o": z.T @ d, "c": d.sum(axis=0)}

    def fit(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 4e-3, decay: float = 1e-4, seed: int = 11) -> AttentionMIL:
        shares = [slice(k, k + 65_536) for k in range(0, len(x), 65_536)]
        self.mean = sum(x[k].sum(axis=0, dtype=float) for k in shares) / len(x)
        self.scale = np.sqrt(sum(((x[k] - self.mean) ** 2).sum(axis=0) for k in shares) / len(x)) + 1e-3
        r, step = np.random.default_rng(seed), 0
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = r.permutation(len(y))
            full = np.cumsum(np.diff(begin)[order]) // STEP_PASSAGES
            for own in np.split(order, np.flatnonzero(full[1:] != full[:-1]) + 1):
                sizes = begin[own + 1] - begin[own]
                at = np.repeat(begin[own] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                g, step = self.gradient((x[at] - self.mean) / self.scale, np.r_[0, np.cumsum(sizes)], y[own]), step + 1
                for n, v in g.items():
                    v = v + decay * self.p[n]
                    m[n], s[n] = 0.9 * m[n] + 0.1 * v, 0.999 * s[n] + 0.001 * v * v
                    self.p[n] = self.p[n] - rate * (1 - epoch / epochs) * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """In groups of bounded bytes; a long text is a group of its own."""
        out, group, size = [], [], 0
        for t in [*texts, None]:
            group.append(t)
            size += len(t or b"") + PASSAGE
            if size >= 2 << 20:
                out.append(self._score(group))
                group, size = [], 0
        return np.concatenate([*out, self._score(group) if group else np.zeros(0)])[: len(texts)]

    def _score(self, group: list[bytes | None]) -> np.ndarray:
        x, begin = encode(group)
        return self.forward((x - self.mean) / self.scale, begin)[-1]


class Prior:
    """Where one of the labels is missing there is nothing to tell texts apart by: every text scores alike, below a half."""

    def __init__(self, value: float):
        self.value = min(0.49, value)

    def score(self, texts: list) -> np.ndarray:
        return np.full(len(texts), self.value)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, rest: int = 1, most: int = MOST_LABELLED) -> AttentionMIL | Prior:
    """Fit on at most `most` labelled rows; every passage of them is encoded on the executors and learned from.

    Rows that repeat an id are all learned from; null texts are empty passages. Where documents or labels
    are empty, or one label is missing, every text scores alike, below a half.
    """
    rows = sample(docs, labels, label, mod, rest, most)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x, begin = encode(as_bytes(part.column(1)))
                x = x.astype(np.float16)
                yield {"id": part.column(0), "label": part.column(2), "x": [x[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]}

    got = sorted((r[0], r[1], bytes(r[2])) for r in arrow_map(rows.select(F.xxhash64("doc_id").alias("id"), "text", "label"), vectors, "id long, label int, x binary").toLocalIterator())
    y = np.array([r[1] for r in got], float)
    if not 0 < y.sum() < len(y):
        return Prior(float(y.mean()) if len(y) else 0.49)
    sizes = [len(r[2]) // (2 * SIZE) for r in got]
    x = np.frombuffer(b"".join(r[2] for r in got), np.float16).reshape(-1, SIZE)
    return AttentionMIL().fit(x, np.r_[0, np.cumsum(sizes)], y)


def op7_quality(spark, sf_dir):
    from slateledger.llm.toxicity import scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")), 3, 1)
