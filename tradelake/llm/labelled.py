"""Labelled rows for the classifiers: all of them, or bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import anchors


def held_out(doc_id: Column, buckets: int, bucket: int) -> Column:
    """Rows by which no classifier learns: crc32 of the id's decimal text, modulo buckets."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % buckets == bucket, F.lit(False))


def known(labels: DataFrame, label: str, buckets: int, bucket: int) -> DataFrame:
    """doc_id, y: labelled ids without the held-out ones and those whose label is null or contradicted by another row."""
    return labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), buckets, bucket)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_z")).where("y = _z").drop("_z")


def every(docs: DataFrame, labels: DataFrame, label: str, buckets: int, bucket: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) for all labelled rows to learn from, whole texts, and the number of ids of each label."""
    ids = known(labels, label, buckets, bucket)
    counts = {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(ids) if sum(counts.values()) <= anchors.BROADCAST_IDS else ids, "doc_id"), counts


def sample(docs: DataFrame, labels: DataFrame, label: str, buckets: int, bucket: int, most: int, longest: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, y) for at most `most` labelled rows of each class, and (y, n) of all rows it could take.

    Held-out rows, and rows whose label is null or contradicted by another row, have no part. Rows are
    taken in the order of a hash of the id; texts of over `longest` bytes are not used for learning.
    """
    ids = known(labels, label, buckets, bucket)
    rates = ids.groupBy("y").agg(F.count("*").alias("n"))
    # a hash range that holds some times the wanted number leaves few rows to sort
    counts = {r.y: r.n for r in rates.collect()}
    picks = None
    for y in (0, 1):
        share = min(1.0, 4 * most / max(1, counts.get(y, 0)))
        part = ids.where((F.col("y") == y) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most)
        picks = part if picks is None else picks.unionByName(part)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= longest))
    return texts.join(F.broadcast(picks), "doc_id"), rates
