"""Toxicity: boosted trees over lexicon densities, second-person proximity, capitals, punctuation and
obfuscation rates, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slateledger.llm.boosting import Boosted, Isotonic
from slateledger.llm.common import arrow_map, as_bytes, held_out, save, ship, table
from slateledger.llm.labelled import folds, sample

#: At most so many labelled rows are used for fitting (and labelled.MOST_BYTES of their text), and so many learned words kept.
MOST_LABELLED, MOST_LEARNED = 12_000, 400
#: A word is learned from this many toxic texts on, at this ratio of its rates.
LEAST_TEXTS, LEAST_RATIO = 3, 6.0
#: Words between an insult and a second-person word.
REACH = 4

# Insults and second-person words.
INSULTS = """idiot idiots idiotic moron morons moronic stupid dumb dumbass fool fools loser losers pathetic worthless disgusting trash
garbage scum clown clowns jerk imbecile cretin dimwit halfwit freak vermin filth filthy pig ugly bastard bitch asshole
crétin imbécile débile connard salaud ordure pourriture minable abruti dégoûtant dummkopf trottel arschloch abschaum widerlich
wertlos versager dreck blöd vollidiot idiota imbécil estúpido estúpida basura asqueroso escoria payaso perdedor inútil""".split()
SECOND_PERSON = "you your yours yourself u ur youre tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes vosotros".split()

_PLAIN = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20) for c in range(256))
_LEET = bytes.maketrans(b"013457@$!|", b"oieastasii")
_SYMBOLS = re.compile(rb"[^a-z\x80-\xff]+")
_MIXED = re.compile(rb"(?<!\S)[A-Za-z]+[0-9@$!|*._#%&-]+[A-Za-z][A-Za-z0-9@$!|*._#%&-]*")
_SPACED = re.compile(rb"(?<![A-Za-z])(?:[A-Za-z][ .*_-]){3,}[A-Za-z](?![A-Za-z])")
_REPEAT = re.compile(rb"([a-z])\1+")
_CAPS_WORD = re.compile(rb"\b[A-Z]{3,}\b")
_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))


@dataclass
class Lexicon:
    fixed: frozenset = field(default_factory=lambda: frozenset(w.encode() for w in INSULTS))
    learned: dict = field(default_factory=dict)
    second: frozenset = field(default_factory=lambda: frozenset(w.encode() for w in SECOND_PERSON))


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters."""
    return text.translate(_PLAIN).split()


def disguised(text: bytes) -> list[bytes]:
    """Words written with look-alike or filling symbols, or letter by letter, undone."""
    out = []
    for m in _MIXED.findall(text):
        low = m.lower()
        out += [_SYMBOLS.sub(b"", low.translate(_LEET)), _SYMBOLS.sub(b"", low)]
    return out + [_SYMBOLS.sub(b"", m.lower()) for m in _SPACED.findall(text)]


FEATURES = ("fixed_density", "fixed_hits", "fixed_kinds", "learned_density", "learned_weight", "learned_most", "near_second", "second_density", "capitals", "caps_words", "exclaims", "questions", "punctuation", "digits", "symbols", "disguised_rate", "disguised_hits", "repeats", "log_words")


def features(text: bytes | None, lex: Lexicon) -> list[float]:
    """One dense vector; an empty text is all zeros."""
    text = text or b""
    words = plain_words(text)
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    hits = [k for k, w in enumerate(words) if w in lex.fixed]
    learned = [lex.learned[w] for w in words if w in lex.learned] if lex.learned else []
    near = second = 0
    if any(w in lex.second for w in set(words)):
        at = np.array([k for k, w in enumerate(words) if w in lex.second])
        second = len(at)
        if hits:
            h = np.array(hits)
            i = np.searchsorted(at, h)
            near = int((np.minimum(np.abs(at[np.minimum(i, len(at) - 1)] - h), np.abs(at[np.maximum(i - 1, 0)] - h)) <= REACH).sum())
    upper, lower = size - len(text.translate(None, _UPPER)), size - len(text.translate(None, _LOWER))
    odd = disguised(text)
    odd_hits = sum(w in lex.fixed or _REPEAT.sub(rb"\1", w) in lex.fixed or w in lex.learned for w in odd)
    digits = size - len(text.translate(None, b"0123456789"))
    symbols = size - len(text.translate(None, b"@#$%^&*_~|\\<>"))
    return [
        1000 * len(hits) / n, np.log1p(len(hits)), float(len({words[k] for k in hits})), 1000 * len(learned) / n, 100 * sum(learned) / n, max(learned, default=0.0), near / max(1, len(hits)),
        1000 * second / n, upper / max(1, upper + lower), len(_CAPS_WORD.findall(text)) / n, text.count(b"!") / n, text.count(b"?") / n, (text.count(b".") + text.count(b",")) / n, digits / size, symbols / n,
        len(odd) / n, float(odd_hits), float(sum(a == b for a, b in zip(words, words[1:], strict=False))) / n, np.log1p(n),
    ]


def learn_words(sampled: DataFrame, least: int = LEAST_TEXTS) -> dict[bytes, float]:
    """Words far more usual in toxic than in other sampled texts, with the log of the ratio."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        by = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                by[label].update(set(plain_words(text or b"")))
        words = list(by[1])
        yield {"word": words, "toxic": [by[1][w] for w in words], "clean": [by[0][w] for w in words]}
        words = [w for w in by[0] if w not in by[1]]
        yield {"word": words, "toxic": [0] * len(words), "clean": [by[0][w] for w in words]}

    totals = {r[0]: r[1] for r in sampled.groupBy("label").count().collect()}
    ratio = ((F.col("toxic") + 0.5) / F.lit(totals.get(1, 0) + 1.0)) / ((F.col("clean") + 0.5) / F.lit(totals.get(0, 0) + 1.0))
    counted = arrow_map(sampled.select("text", "label"), count, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = counted.where(F.col("toxic") >= least).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("toxic"), F.desc("ratio"), "word").limit(MOST_LEARNED).collect()
    return {bytes(r["word"]): float(np.log(r["ratio"])) for r in rows}


class Model:
    """A lexicon, trees and a calibration; without both labels there is nothing to tell texts apart by, and
    it scores every text alike, below a half."""

    def __init__(self, lexicon: Lexicon, trees: Boosted | None, calibrate: Isotonic | None, prior: float):
        self.lexicon, self.trees, self.calibrate, self.prior = lexicon, trees, calibrate, prior

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        if not texts:
            return np.zeros(0)
        return self.calibrate(self.trees.margin(np.array([features(t, self.lexicon) for t in texts])))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, rest: int = 0, most: int = MOST_LABELLED) -> Model:
    """Fit on at most `most` labelled rows. Words are learned on one half to make features of the other, so
    that no text is judged by words learned from itself; the calibration sees out-of-fold margins only.

    Rows that repeat an id are all learned from, in the same half; null texts are empty. Where documents or
    labels are empty, or one label is missing, every text scores alike, below a half.
    """
    rows = save(sample(docs, labels, label, mod, rest, most))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    lex = [Lexicon(learned=learn_words(rows.where(half != k))) for k in (0, 1)]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch.column(0), "label": batch.column(2), "x": [features(t, lex[h]) for t, h in zip(as_bytes(batch.column(1)), batch.column(3).to_pylist(), strict=True)]}

    got = arrow_map(rows.select(F.xxhash64("doc_id").alias("doc_id"), "text", "label", half.cast("int").alias("half")), vectors, "doc_id long, label int, x array<double>").orderBy("doc_id", "label", "x").toPandas()
    y = got["label"].to_numpy(float)
    final = Lexicon(learned=learn_words(rows))
    if not 0 < y.sum() < len(y):
        return Model(final, None, None, min(0.49, float(y.mean())) if len(y) else 0.49)
    x, fold, out = np.array(got["x"].tolist()), folds(got["doc_id"].to_numpy().view(np.uint64), 4), np.zeros(len(y))
    for k in range(4):
        train = fold != k
        if 0 < y[train].sum() < train.sum():
            out[~train] = Boosted().fit(x[train], y[train]).margin(x[~train])
    return Model(final, Boosted().fit(x, y), Isotonic(out, y), float(y.mean()))


def scorer(docs: DataFrame, model, text_col: str = "text") -> Column:
    """The model's score of a text column, as a column. Null and empty texts have a score, too, and repeated
    rows the same one; an empty table has no scores. No other column is read, whatever its name."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        values = as_bytes(text)
        parts = [shared.value.score(values[k : k + 1024]) for k in range(0, len(values), 1024)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(docs[text_col].cast("string"))


def scored(docs: DataFrame, model, mod: int, rest: int) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. A null id is held out as the empty text's
    remainder says; repeated rows have equal results; an empty table gives an empty result."""
    out = docs.select(docs["doc_id"], scorer(docs, model).alias("score"))
    return out.select("doc_id", held_out("doc_id", mod, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")), 5, 0)
