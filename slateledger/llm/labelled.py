"""Bounded samples of labelled rows, and folds of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateledger.llm.common import held_out, save


#: Text that a sample may have in all.
MOST_BYTES = 128 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, most: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, text, label), a written table: at most `most` labelled rows outside the held-out rest, chosen
    by a hash of the id, and of these, in that order, as many whole texts as `most_bytes` hold in all.

    Null ids and labels are left out; of several labels for an id the largest counts. Rows of documents that
    repeat an id count one by one: an id at which the bound is reached gives only some of its rows, by a hash of
    the text. Empty tables give an empty sample.
    """
    ids = labels.select(labels[id_col].alias("doc_id"), labels[label].cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = save(ids.where(~held_out("doc_id", mod, rest)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # at most `most` ids
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # how many rows each id has: at most `most` numbers
    counts = src.select("doc_id").join(F.broadcast(ids), "doc_id").groupBy("doc_id").count().orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    whole, left, cut = [], most, None
    for doc, n in counts:
        if n > left:
            cut = doc
            break
        whole.append((doc,))
        left -= n
    kind = src.schema["doc_id"].dataType.simpleString()
    rows = src.join(F.broadcast(ids.join(F.broadcast(docs.sparkSession.createDataFrame(whole, f"doc_id {kind}")), "doc_id")), "doc_id")
    if cut is not None and left:
        some = src.where(F.col("doc_id") == F.lit(cut)).orderBy(F.xxhash64("text"), "text").limit(left)
        rows = rows.unionByName(some.join(F.broadcast(ids), "doc_id"))
    rows = save(rows.withColumn("_n", F.monotonically_increasing_id()))
    sizes = rows.select("_n", F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)).cast("long").alias("size"), F.xxhash64("doc_id").alias("h")).orderBy("h", "_n").collect()  # at most `most` rows
    fit = np.searchsorted(np.cumsum([r["size"] for r in sizes]), most_bytes, side="right") if sizes else 0
    if fit < len(sizes):
        kept = docs.sparkSession.createDataFrame([(r["_n"],) for r in sizes[:fit]], "_n long")
        rows = rows.join(F.broadcast(kept), "_n", "left_semi")
    return rows.select("doc_id", "text", "label")


def folds(ids: np.ndarray, k: int) -> np.ndarray:
    """A fold for each row from its id alone."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(k)
