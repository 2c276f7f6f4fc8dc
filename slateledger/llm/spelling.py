"""Spelling variants: words one inserted, deleted or replaced code point apart, and the common form of each.

Of two words of which the shorter has m letters, the edit's place p (the length of their common prefix, 0 to m)
lies in one half of it, and the other half is intact. So a word enters, for m its own length and one less, a
block of the forward dictionary (the first half shared, p behind it) and a block of the reversed one (the second
half shared, p before it): each pair of near words meets in exactly one block, the one whose range [x, y) of
places holds p. A block beyond HOT words has its range cut again in the middle, which fixes more letters, until
it is small enough or its range is one letter long; after that the alphabet bounds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slateledger.llm.common import arrow_map, mix, parts_for, runs, save, table, texts

#: Letters of a word, as the contract has them.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LETTERS, MIN_COUNT, TIMES, DELETE_MOD = 7, 2, 10, 31
#: Words of a block that one task scans; more are cut by another half of the range.
HOT = 4096
#: Words of a run that are compared with each other; in a task, longer runs are cut in the same way.
SMALL = 24
#: Letters that a task holds at once (a block is never torn).
PIECE = 2 << 20
KEY = ["m", "x", "y", "pre", "suf"]


def typed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LETTERS, mod: int = DELETE_MOD) -> DataFrame:
    """Every occurrence of a word of `least` letters and more, with the letters that the contract deletes taken
    out; a null id counts as the empty text, a null text has none."""
    low = texts(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("w"))
    low = low.where(F.char_length("w") >= least).select("d", F.translate("w", UPPER, LOWER).alias("w"))
    h = low.select("w", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")).alias("h")).withColumn("at", (F.col("h") % F.char_length("w")).cast("int"))
    cut = F.concat(F.col("w").substr(F.lit(1), F.col("at")), F.col("w").substr(F.col("at") + 2, F.char_length("w")))
    return h.select(F.when(F.col("h") % mod == 0, cut).otherwise(F.col("w")).alias("word")).where(F.char_length("word") >= least)


def block(m: Column, x: Column, y: Column) -> Column:
    """The block of a word for shorter length m and places [x, y): what lies outside is its key."""
    w = F.col("word")
    return F.struct(m.alias("m"), x.alias("x"), y.alias("y"), w.substr(F.lit(1), x).alias("pre"), w.substr(F.char_length(w) - (m - y) + 1, m - y).alias("suf"))


def halves(m: Column, x: Column, y: Column) -> list[Column]:
    mid = (x + F.floor((y - x) / 2)).cast("int")
    return [block(m, mid, y), block(m, x, mid)]


def dictionary(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(m, x, y, pre, suf, word, n): every word in its blocks, none of more than `hot` words unless its range of
    places is one letter or less. Sorting by the key and the word gives the forward dictionary where suf is empty
    and the reversed one where pre is; ranges cut again have both."""
    n, zero = F.char_length("word"), F.lit(0)
    own = [b for m in (n, n - 1) for b in halves(m, zero, m)]
    rows, done = words.select("word", "n", F.explode(F.array_distinct(F.array(*own))).alias("b")).where("b.m >= 0").select("b.*", "word", "n"), []
    while True:
        rows = save(rows)
        big = rows.groupBy(*KEY).agg(F.count("*").alias("size")).where((F.col("size") > hot) & (F.col("y") - F.col("x") > 1)).select(*[F.col(k).alias(f"_{k}") for k in KEY])
        if big.isEmpty():
            return union([*done, rows])
        big = save(big)
        same = [rows[k] == big[f"_{k}"] for k in KEY]
        done.append(rows.join(big, same, "left_anti"))
        cut = rows.join(big, same, "left_semi")
        rows = cut.select("word", "n", F.explode(F.array(*halves(F.col("m"), F.col("x"), F.col("y")))).alias("b")).select("b.*", "word", "n")


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


class Words:
    """Words of m and m + 1 letters as rows of code points; the neighbours of each are counted, and the best kept."""

    def __init__(self, m: int, words: list[str], counts: np.ndarray):
        self.m, self.n = m, counts
        flat = "".join(words)
        try:
            code = np.frombuffer(flat.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.long = np.fromiter(map(len, words), np.int64, len(words)) > m
        start = np.cumsum(self.long + m) - (self.long + m)
        self.a = np.zeros((len(words), m + 1), code.dtype)
        self.a[:, :m] = code[start[:, None] + np.arange(m)]
        self.a[self.long, m] = code[start[self.long] + m]
        # the words' places in code-point order, for ties
        self.rank = np.empty(len(words), np.int64)
        self.rank[np.lexsort(self.a.T[::-1])] = np.arange(len(words))
        self.near = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), -1, np.int64)

    def scan(self, idx: np.ndarray, ctx: np.ndarray, x: int, y: int, small: int) -> None:
        """Search the runs of equal ctx among the words idx for places [x, y)."""
        order = np.argsort(ctx, kind="stable")
        idx, ctx = idx[order], ctx[order]
        start, length = runs(ctx)
        if not len(start):
            return
        short = np.add.reduceat(~self.long[idx], start)  # a run needs two words, one of them of m letters
        keep = (length > 1) & (short > 0)
        big = keep & (length > small) if y - x > 1 else np.zeros(len(keep), bool)
        pick = np.repeat(keep & ~big, length)
        self.compare(idx[pick], ctx[pick], x, y)
        if not big.any():
            return
        pick = np.repeat(big, length)
        idx, ctx, mid = idx[pick], ctx[pick], x + (y - x) // 2
        self.scan(idx, self.extend(idx, ctx, np.full(len(idx), x), mid - x), mid, y, small)
        self.scan(idx, self.extend(idx, ctx, mid + self.long[idx], y - mid), x, mid, small)

    def extend(self, idx: np.ndarray, ctx: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """The context with `size` more letters from place `at` of each word on, as a hash: what shares it by
        chance is told apart when words are compared."""
        for k in range(size):
            ctx = mix(ctx ^ self.a[idx, at + k].astype(np.uint64), 3)
        return ctx

    def compare(self, idx: np.ndarray, ctx: np.ndarray, x: int, y: int) -> None:
        """All pairs of each run, by growing distance in the sorted order; only sums and the best word are kept."""
        for d in range(1, len(idx)):
            i = np.flatnonzero(ctx[d:] == ctx[:-d])
            if not len(i):
                return
            a, b = idx[i], idx[i + d]
            both = self.long[a] & self.long[b]
            a, b = a[~both], b[~both]
            a, b = np.where(self.long[a], b, a), np.where(self.long[a], a, b)  # the longer one second
            self.pair(a, b, x, y)

    def pair(self, a: np.ndarray, b: np.ndarray, x: int, y: int) -> None:
        m, rows = self.m, max(1, (4 << 20) // (self.m + 1))
        for k in range(0, len(a), rows):
            s, t = self.a[a[k : k + rows]], self.a[b[k : k + rows]]
            more = self.long[b[k : k + rows]]
            p = np.logical_and.accumulate(s[:, :m] == t[:, :m], axis=1).sum(axis=1)
            rest = np.logical_and.accumulate(np.where(more[:, None], s[:, :m] == t[:, 1:], s[:, :m] == t[:, :m])[:, ::-1], axis=1).sum(axis=1)
            ok = np.where(more, p + rest >= m, p + rest == m - 1) & (p >= x) & ((p < y) | (y == m))
            self.count(a[k : k + rows][ok], b[k : k + rows][ok])

    def count(self, a: np.ndarray, b: np.ndarray) -> None:
        for own, other in ((a, b), (b, a)):
            self.near += np.bincount(own, minlength=len(self.near))
            order = np.lexsort((self.rank[other], -self.n[other], own))
            own_, other_ = own[order], other[order]
            first = np.flatnonzero(np.r_[np.ones(min(1, len(own_)), bool), own_[1:] != own_[:-1]])
            o, c = own_[first], other_[first]
            held = self.best[o]
            better = (held < 0) | (self.n[c] > self.n[held]) | ((self.n[c] == self.n[held]) & (self.rank[c] < self.rank[held]))
            self.best[o[better]] = c[better]


def neighbours(blocks: DataFrame, parts: int, small: int = SMALL) -> DataFrame:
    """(word, n_near, best n and word) of each word within each block that has a neighbour of it: the sorted
    dictionaries are range-partitioned by block and scanned run by run."""
    keys = [F.col(k) for k in KEY]
    ordered = blocks.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "word")

    def search(pieces: Iterator[pa.Table]) -> Iterator[dict]:
        for t in pieces:
            m, x, y = (t.column(c).to_numpy() for c in ("m", "x", "y"))
            words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
            ctx = t.column("ctx").to_numpy()
            kind = np.flatnonzero(np.r_[True, (np.diff(m) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)])
            for lo, hi in zip(kind.tolist(), [*kind[1:].tolist(), len(m)], strict=True):
                w = Words(int(m[lo]), words[lo:hi], n[lo:hi])
                w.scan(np.arange(hi - lo), mix(ctx[lo:hi].astype(np.uint64)), int(x[lo]), int(y[lo]), small)
                has = np.flatnonzero(w.near)
                if len(has):
                    best = w.best[has]
                    yield {"word": [words[lo + k] for k in has.tolist()], "n_near": w.near[has], "best_n": w.n[best], "best": [words[lo + k] for k in best.tolist()]}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables that end where a block does; a block's number stands for its key."""
        held, size, block, last = [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            key = list(zip(*(t.column(k).to_pylist() for k in KEY), strict=True))
            ids, before = np.empty(len(key), np.int64), last
            for i, k in enumerate(key):
                if k != before:
                    block, before = block + 1, k
                ids[i] = block
            t = t.drop_columns(["pre", "suf"]).append_column("ctx", pa.array(ids))
            cut = int(np.searchsorted(ids, ids[-1]))  # where the batch's last block begins
            if size >= PIECE and (cut or key[0] != last):
                yield pa.concat_tables([*held, t.slice(0, cut)])
                held, size, t = [], 0, t.slice(cut)
            held.append(t)
            size += t.column("word").nbytes
            last = key[-1]
        if held:
            yield pa.concat_tables(held)

    return arrow_map(ordered.select(*KEY, "word", "n"), lambda batches: search(whole(batches)), "word string, n_near long, best_n long, best string")


def spelling_variants(words: DataFrame, times: int = TIMES, hot: int = HOT, small: int = SMALL) -> DataFrame:
    """One row per word of words (word string, n long; distinct, not null): word, form, root, n, n_near, form_n.

    n_near counts the words one edit apart; the form is the one of largest n (of equals the first in code-point
    order) if its n is at least `times` the word's own; root follows forms to the last. Words without
    neighbours have n_near 0, no form, and are their own root. An empty table gives an empty one. Words may have any
    letters and lengths.
    """
    words = save(words)
    parts = parts_for(0)
    stats = words.agg(F.sum(F.octet_length("word") + 8).alias("size"), F.max("n").alias("most")).first()
    if stats["size"]:
        parts = parts_for(4 * stats["size"], 2 << 20)
    found = neighbours(dictionary(words, hot), parts, small).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))).alias("best"))
    fits = -F.col("best.k") >= times * F.col("n")
    out = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.k")).alias("form_n"))
    out = save(out)
    # n grows `times`-fold with every step, so a chain of forms is no longer than a logarithm of the largest n
    steps = math.log(max(2, stats["most"] or 2)) / math.log(times) if times > 1 else 64
    to = out.where("form is not null").select(F.col("word").alias("src"), F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps + 1))))):
        on = to.select(F.col("src").alias("src2"), F.col("root").alias("root2"))
        to = save(to.join(on, to["root"] == on["src2"], "left").select("src", F.coalesce("root2", "root").alias("root")))
    return out.join(to, out["word"] == to["src"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir):
    words = typed_words(table(spark, sf_dir, "documents")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)
    return spelling_variants(words)


#: A byte's CRC by the polynomial's rule, then the sum over the bytes of a text (all letters are below U+0100).
CRC_SQL = """
    bits AS (SELECT list(b ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS b FROM range(256) r(i)))
"""
OP12_SQL = f"""
WITH {CRC_SQL},
runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(w, '{UPPER}', '{LOWER}') AS w
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= {MIN_LETTERS}
),
bytes AS (
    SELECT d, w, flatten(list_transform(string_split(d || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS b
    FROM (SELECT DISTINCT d, w FROM runs)
),
sums AS (SELECT d, w, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) AS h FROM bytes, bits),
typed AS (
    SELECT CASE WHEN h % {DELETE_MOD} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word
    FROM runs JOIN sums USING (d, w)
),
words AS (SELECT word, count(*) AS n FROM typed WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING count(*) >= {MIN_COUNT}),
gaps AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS near, b.n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word
),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS near, max(n) AS most FROM pairs GROUP BY word),
formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= {TIMES} * w.n THEN b.near END AS form, CASE WHEN b.most >= {TIMES} * w.n THEN b.most END AS form_n
    FROM words w LEFT JOIN best b USING (word)
),
chain AS (WITH RECURSIVE c AS (SELECT word, word AS last, form AS next FROM formed UNION ALL SELECT c.word, f.word, f.form FROM c JOIN formed f ON c.next = f.word) SELECT word, last AS root FROM c WHERE next IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
"""
