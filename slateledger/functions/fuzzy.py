"""Closest place name to a run of words, as difflib measures closeness; for texts without a known place."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import get_close_matches

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slateledger.functions import constants as C
from slateledger.functions import scalars as S
from slateledger.shipping import ship

CUTOFF = 0.78
_OTHER = re.compile("[^a-z ]+")
_NAMES = list(C.IMAGE_STATES.values())
_LOW = {n.lower(): n for n in reversed(_NAMES)}


#: Runs of words whose closest name a worker remembers.
REMEMBERED = 200_000
_held: dict[str, str] = {}


def close_place(words: str) -> str:
    found = get_close_matches(words, [n.lower() for n in _NAMES], n=1, cutoff=CUTOFF)
    return _LOW[found[0]] if found else ""


def _counts(texts: list[str]) -> np.ndarray:
    """How often each text has each letter, and the space: all signs that names are made of."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    code = np.where((flat >= 97) & (flat <= 122), flat - 97, np.where(flat == 32, 26, 27))
    return np.bincount(owner * 28 + code, minlength=28 * len(texts)).reshape(-1, 28)[:, :27].astype(np.int16)


def _settle(runs: list[str]) -> None:
    """Put the closest name of each run aside. Twice the signs in common, in any order, over both lengths bounds the
    ratio, as in difflib's own quick ratio: only runs that reach the cutoff so with some name are compared."""
    names = [n.lower() for n in _NAMES]
    own, size = _counts(names), np.array([len(n) for n in names])
    for k in range(0, len(runs), 4096):
        part = runs[k : k + 4096]
        common = np.minimum(_counts(part)[:, None, :], own[None]).sum(axis=2)
        bound = 2.0 * common / (np.array([len(r) for r in part])[:, None] + size)
        for run, may in zip(part, (bound >= CUTOFF).any(axis=1).tolist(), strict=True):
            _held[run] = close_place(run) if may else ""


def _runs(text: str | None) -> Iterator[str]:
    """Runs of 2, 3 and 1 words from each place on; a run beyond the end ends the tries at its place. Left out are runs that
    no name can be close to: names are letters and spaces, so no more than those of the run can match, and the
    ratio is at most twice their number over both lengths."""
    words = (text or "").lower().split()
    size = [len(w) for w in words]
    plain = [n if w.isascii() and w.isalpha() else len(_OTHER.sub("", w)) for w, n in zip(words, size, strict=True)]
    for i in range(len(words)):
        for n in (2, 3, 1):
            if i + n > len(words):
                break
            long, letters = sum(size[i : i + n]) + n - 1, sum(plain[i : i + n]) + n - 1
            if long >= 3 and 2 * letters >= CUTOFF * (long + max(letters, 3)):
                yield " ".join(words[i : i + n])


def fuzzy_places(texts: list[str | None]) -> list[str]:
    """For each text the closest name of the first of its runs that has one, else the empty text."""
    runs = [list(_runs(t)) for t in texts]
    if len(_held) > REMEMBERED:
        _held.clear()
    _settle(list({r for own in runs for r in own if r not in _held}))
    return [next((name for r in own if (name := _held[r])), "") for own in runs]


def fuzzy_place(text: str | None) -> str:
    return fuzzy_places([text])[0]


@F.arrow_udf(T.StringType())
def _fuzzy(text: pa.Array) -> pa.Array:
    return pa.array(fuzzy_places(text.to_pylist()), pa.string())


def placed(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the place of its text column. Closest names are looked up once for each distinct text without a
    known place and joined back, so that df is computed twice: for tables, not for long chains of steps."""
    ship(df.sparkSession)
    known = df.withColumn(out, S.place_contained(text))
    near = known.where(F.col(out) == "").select(F.col(text).alias("_text")).distinct().select("_text", _fuzzy("_text").alias("_near"))
    return known.join(near, F.col(text) == F.col("_text"), "left").withColumn(out, F.coalesce("_near", out)).drop("_text", "_near")


def place(text: Column | str) -> Column:
    """A place that the text contains, else the closest one. Rows of texts with a known place pass the Python
    step, too, as nulls: splitting them off would compute the steps before it twice."""
    ship()
    known = S.place_contained(text)
    return F.when(known != "", known).otherwise(_fuzzy(F.when(known == "", S.col(text))))
