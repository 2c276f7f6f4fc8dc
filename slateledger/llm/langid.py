"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateledger.llm.common import arrow_map, held_out, table

ORDERS = (1, 2, 3)
#: Hashed n-grams fall into this many buckets; the model is buckets x languages.
BUCKETS = 1 << 16
#: Characters scored at once, in whole texts: a longer text is scored alone, at some 40 bytes a character.
CHUNK = 1 << 18
SMOOTHING = 0.5
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(unicodedata.category(c)[0] == "L" for c in text)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each with a line end before and after; where each begins."""
    low = ["\n" + t.lower() + "\n" for t in texts]
    lens = np.fromiter(map(len, low), np.int64, len(low))
    flat = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.r_[0, np.cumsum(lens)]


def buckets(flat: np.ndarray, order: int, n: int = BUCKETS) -> np.ndarray:
    """The bucket of the n-gram at each place."""
    h = np.full(max(0, len(flat) - order + 1), order, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = (h ^ flat[k : k + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
    return (h & np.uint32(n - 1)).astype(np.int32)


def inside(begin: np.ndarray, order: int, size: int) -> np.ndarray:
    """Whether the n-gram at each place lies within one text."""
    ok = np.ones(size, bool)
    for k in range(1, order):
        ends = begin[1:] - k
        ok[ends[(ends >= 0) & (ends < size)]] = False
    return ok


def count_ngrams(docs: DataFrame, text_col: str, lang_col: str, n: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n): counts over every whole text, summed within each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                total = held.setdefault(lang, np.zeros(n, np.int64))
                for group in _groups(own):
                    flat, begin = codes(group)
                    for order in ORDERS:
                        b = buckets(flat, order, n)
                        total += np.bincount(b[inside(begin, order, len(b))], minlength=n)
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield {"lang": [lang] * len(at), "bucket": at, "n": total[at]}

    used = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("text is not null and lang is not null")
    return arrow_map(used, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _groups(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 2
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


class Model:
    """Log-probabilities, buckets x languages; priors are the languages' shares of the training texts."""

    def __init__(self, langs: list[str], counts: np.ndarray, documents: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.log = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        self.prior = np.log((documents + 1) / (documents + 1).sum())

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihoods, texts x languages, by sums of the matrix's rows at the texts' n-grams."""
        flat, begin = codes(texts)
        out = np.tile(self.prior, (len(texts), 1))
        for order in ORDERS:
            b = buckets(flat, order, len(self.log))
            ok = inside(begin, order, len(b))
            owner = np.repeat(np.arange(len(texts)), np.diff(begin))[: len(b)][ok]
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(owner, weights=self.log[b[ok], k], minlength=len(texts))
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_langs: int = 512) -> Model:
    """Learn from all given rows with a text and a language. The model has at most BUCKETS x most_langs
    entries (a documented bound; more languages than that are refused, not dropped)."""
    counted = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    langs = sorted((r[0], r[1]) for r in counted.groupBy(F.col(lang_col).cast("string")).count().limit(most_langs + 1).collect())
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    at = {x: k for k, (x, _) in enumerate(langs)}
    counts = np.zeros((BUCKETS, max(1, len(langs))), np.int64)
    rows = count_ngrams(docs, text_col, lang_col).groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    for lang, b, n in rows.toLocalIterator():
        counts[np.array(b), at[lang]] = n
    return Model([x for x, _ in langs], counts, np.array([n for _, n in langs] or [0]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    `und` with score 0 where the text is null or has no letter, or nothing could be learned. Of equally likely languages the
    first by name counts. Repeated rows
    give repeated results. The score is the posterior, per n-gram so that long texts don't all give 1.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = shared.value
        for batch in batches:
            texts_ = batch.column(1).to_pylist()
            known = [bool(m.langs) and has_letter(t) for t in texts_]
            pred, conf = ["und"] * len(texts_), np.zeros(len(texts_))
            at = np.flatnonzero(known).tolist()
            done = 0
            for group in _groups([texts_[k] for k in at]):
                s = m.scores(group)
                size = np.array([len(t) + 2 for t in group])[:, None]
                e = np.exp((s - s.max(axis=1, keepdims=True)) / np.sqrt(size))
                for k, best, p in zip(at[done : done + len(group)], s.argmax(axis=1).tolist(), (e / e.sum(axis=1, keepdims=True)).max(axis=1), strict=True):
                    pred[k], conf[k] = m.langs[best], p
                done += len(group)
            yield {"doc_id": batch.column(0), "lang_pred": pred, "score": conf}

    return arrow_map(src, predict, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    out = identify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


