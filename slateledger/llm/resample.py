"""Resampling towards a target by importance: hashed n-grams, counted by sorting, weighed by log ratios, drawn by Gumbel keys.

Every document's features are packed as a stream of uint16 buckets, many documents to a row, with the offset of each
document's first one; the streams are written once. Counts come from sorting each stream and encoding its runs, and
from adding up the runs of all streams by bucket. With the buckets' gains at hand (a table of as many entries as
there are buckets) the streams are read again, and np.add.reduceat sums the gains from offset to offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slateledger.llm.common import arrow_map, as_bytes, input_bytes, parts_for, runs, save, table, texts

ORDER, BUCKETS, SEED, PERCENT, MIN_WORDS = 1, 10_000, 2024, 10, 20
#: Text of one packed row; a longer document is a row of its own.
STREAM_BYTES = 4 << 20
#: Bytes of scored rows that one range of the ranking holds.
RANK_BYTES = 32 << 20
#: Distinct features whose buckets a task remembers.
REMEMBERED = 1 << 19
#: A-Z folded; what is no ASCII letter or digit and below 0x80 separates words.
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20) for c in range(256))


class Buckets(dict):
    """The bucket of a feature, worked out when it is first asked for."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.buckets
        return out


def features(text: bytes | None, order: int) -> tuple[list[bytes], int]:
    """All runs of 1 to `order` consecutive words, joined by one space; how many words there are."""
    words = (text or b"").translate(_FOLD).split()
    out = list(words)
    for n in range(2, order + 1):
        out += [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
    return out, len(words)


def pack(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (ids, words, offsets, stream): the buckets of many documents end to end, compressed uint16, and where
    each document's begin. A written table. A null text has no words."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are packed as 16 bits")
    src = texts(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        z, bucket = zstandard.ZstdCompressor(1), Buckets(buckets).__getitem__
        ids, words, lens, held, size = [], [], [], [], 0

        def row() -> dict:
            ends = np.cumsum(np.array(lens, np.int64))
            return {"ids": [ids], "words": [np.array(words, np.int64).tobytes()], "offsets": [np.r_[0, ends].tobytes()], "stream": [z.compress(np.concatenate(held).tobytes())]}

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                own, n = features(text, order)
                ids.append(doc)
                words.append(n)
                lens.append(len(own))
                held.append(np.fromiter(map(bucket, own), np.uint16, len(own)))
                size += len(text or b"") + 32
                if size >= STREAM_BYTES:
                    yield row()
                    ids, words, lens, held, size = [], [], [], [], 0
        if ids:
            yield row()

    return save(arrow_map(src, run, f"ids array<{kind}>, words binary, offsets binary, stream binary"))


def stream(row: dict) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["stream"]), np.uint16)


def count(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: streams sorted and run-length encoded, runs added up by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.sort(stream(row))
                start, length = runs(own)
                yield {"bucket": own[start].astype(np.int32), "n": length}

    out = np.zeros(buckets, np.int64)
    for r in arrow_map(packed.select("stream"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most 2^16 rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source, smoothed by one, floored; one a bucket."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.floor(1000 * np.log((target + 1) * float(s + n) / ((source + 1) * float(t + n)))).astype(np.int64)


def weigh(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean of the gains of a document's features; 0 without any)."""
    shared = packed.sparkSession.sparkContext.broadcast(gain)
    kind = packed.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["offsets"], np.int64)
                n = np.diff(at)
                total = np.zeros(len(n), np.int64)
                if at[-1]:  # reduceat can't sum nothing: only documents that have features
                    total[n > 0] = np.add.reduceat(shared.value[stream(row)], at[:-1][n > 0])
                yield {"doc_id": row["ids"], "n_words": np.frombuffer(row["words"], np.int64), "n_features": n, "weight": total // np.maximum(n, 1)}

    return arrow_map(packed, run, f"doc_id {kind}, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """With score: the weight and a Gumbel variable that the id's SHA-256 sets, in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weights.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(u))).cast("long"))


def ranked(rows: DataFrame, parts: int, most: int | None = None) -> DataFrame:
    """rows with rank 1, 2, 3... by falling score, then rising doc_id (a null one last): ranges of that order, whose
    sizes give where each begins, and a rank within each. Rows that repeat an id and a score are dealt by their place
    in the table, so that they don't meet in one task. `most`: only the first so many."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    cut = save(rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in cut.groupBy("_part").count().collect())  # a row for each of the parts
    begins = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    first = cut.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, begins, strict=False)], "_of int, _first long")
    cut = cut.join(F.broadcast(first), F.col("_part") == F.col("_of")).drop("_of")
    if most is not None:
        cut = cut.where(F.col("_first") < most)  # whole ranges beyond the draw aren't sorted
    out = cut.withColumn("rank", (F.col("_first") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))).cast("long"))
    return out.where(F.col("rank") <= most) if most is not None else out


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where not drawn), all by the table's rows.

    Of the documents of at least min_words words, floor(percent * their number / 100) are drawn, highest scores first, of
    ties the smaller doc_id (a null one last; rows that repeat an id are drawn one by one). A null or empty text
    has no features and weight 0. An empty target or table leaves the smoothed ratios as they are.
    """
    own = pack(docs, order, buckets, id_col, text_col)
    goal = pack(target.select(F.lit(0).alias("_goal"), target[target_col].alias("_text")), order, buckets, "_goal", "_text")
    gain = gains(count(own, buckets), count(goal, buckets))
    rows = save(scored(weigh(own, gain), seed).withColumn("_at", F.monotonically_increasing_id()))
    fit = rows.where(F.col("n_words") >= min_words)
    drawn = ranked(fit.select("doc_id", "score", "_at"), parts_for(input_bytes(rows), RANK_BYTES), percent * fit.count() // 100)
    return rows.join(drawn.select(F.col("_at").alias("_drawn"), "rank"), F.col("_at") == F.col("_drawn"), "left").select("doc_id", "n_features", "weight", "score", "rank")


def op13_resample(spark, sf_dir):
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = f"""
WITH bits AS (SELECT list(b ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS b FROM range(256) r(i))),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
own AS (SELECT r, unnest(ws) AS w FROM docs),
goal AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
distinct_words AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM own UNION ALL SELECT w FROM goal)),
bucket AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % {BUCKETS} AS b FROM distinct_words, bits),
ns AS (SELECT b, count(*) AS s FROM own JOIN bucket USING (w) GROUP BY b),
nt AS (SELECT b, count(*) AS t FROM goal JOIN bucket USING (w) GROUP BY b),
alls AS (SELECT (SELECT count(*) FROM own) AS s_all, (SELECT count(*) FROM goal) AS t_all),
gain AS (SELECT ns.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS g FROM ns LEFT JOIN nt USING (b), alls),
sums AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN bucket USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (
    SELECT docs.r, doc_id, coalesce(len(ws), 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM docs LEFT JOIN sums USING (r)
),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, d.rank FROM scored LEFT JOIN (SELECT r, rank FROM drawn WHERE rank <= {PERCENT} * n // 100) d USING (r)
"""
