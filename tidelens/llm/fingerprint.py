"""Quartile bucket digests of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import flat_bytes, sha

BUCKETS = 256
#: Places of a triplet inside a window of four bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
LENGTH_CAP = 24    # length codes that count at most
DIFF_CAP = 440     # a difference from here on is no likeness; unrelated prose lies around it
_STEP = np.array([0, 1, 2, 6])  # what codes 0 to 3 apart add to the difference


def digest(data: np.ndarray) -> str:
    """The fingerprint of one text's bytes: length code, then two bits per bucket, in hex.

    Every byte triplet of the sliding window is hashed to a bucket; a bucket's code tells in which
    quartile of all bucket counts its own count lies. The empty text has length code 0 and codes 0.
    """
    counts = np.zeros(BUCKETS, np.int64)
    x = data.astype(np.uint32)
    for kind, (a, b, c) in enumerate(TRIPLETS):
        n = len(x) - c
        if n <= 0:
            continue
        h = x[a:a + n] * np.uint32(0x01000193) + x[b:b + n] * np.uint32(0x9E3779B1)
        h += x[c:c + n] * np.uint32(0x85EBCA6B) + np.uint32(kind * 0x27D4EB2F)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    low, mid, high = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > low).astype(np.uint8) + (counts > mid) + (counts > high)
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    length = min(255, round(8 * np.log1p(len(data))))
    return bytes([length]).hex() + packed.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Bounded difference of two fingerprints: code steps of all buckets and length codes apart, at most DIFF_CAP."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    split = np.array([6, 4, 2, 0], np.uint8)
    codes = [(v[1:, None] >> split) & 3 for v in (x, y)]
    apart = np.abs(codes[0].astype(np.int64) - codes[1])
    total = int(_STEP[apart].sum()) + min(LENGTH_CAP, abs(int(x[0]) - int(y[0])))
    return min(total, DIFF_CAP)


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, 0 from DIFF_CAP on."""
    return 1.0 - difference(a, b) / DIFF_CAP


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` plus the fingerprint of the whole text. No shuffle.

    A null text counts as empty; equal texts have equal fingerprints; an empty table gives an
    empty result; ``out`` replaces a column of that name.
    """
    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_bytes(batch.column(kept.index(text)))
            own = [digest(data[ends[i]:ends[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], names=[*kept, out])

    return docs.select(*kept).mapInArrow(run, docs.select(*kept).withColumn(out, F.lit("")).schema)


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (_bucket, _borrowed, id, text) by which each document meets the next one in order of id.

    Ids are cut into ranges by approximate quantiles; a range's first document also goes to the
    range before it (the first range's to the last), marked as borrowed. Partitioned by range and
    sorted in each, so a reader needs one row besides its own. What reaches the driver is a cut and
    a first id for each range. A null id comes first; equal ids are ordered by text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    shares = [i / (4 * parts) for i in range(1, 4 * parts)]
    cuts = sorted(set(rows.approxQuantile("_id", shares, 0.1 / parts)))
    bucket = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("_bucket", F.when(F.col("_id").isNull(), 0).otherwise(bucket))
    heads = (rows.groupBy("_bucket").agg(F.min("_id").alias("first"), F.max(F.col("_id").isNull()).alias("null"))
             .orderBy("_bucket").collect())
    if not heads:
        return rows.withColumn("_borrowed", F.lit(False))
    before, first = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for h, prior in zip(heads, [heads[-1], *heads[:-1]], strict=True):
        before[h["_bucket"]], first[h["_bucket"]] = prior["_bucket"], h["first"] if h["first"] is not None else 0
    head = F.when(F.lit(bool(heads[0]["null"])) & (F.col("_bucket") == 0), F.col("_id").isNull()).otherwise(
        F.col("_id") == F.get(F.lit(first), F.col("_bucket")))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("l"))
    lent = F.struct(F.get(F.lit(before), F.col("_bucket")).alias("b"), F.lit(True).alias("l"))
    return (rows.withColumn("_to", F.explode(F.when(head, F.array(own, lent)).otherwise(F.array(own))))
            .select(F.col("_to.b").alias("_bucket"), F.col("_to.l").alias("_borrowed"), "_id", "_text")
            .repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_borrowed", "_id", "_text"))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: fingerprints of the whole text and of the text edited with the next document.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of
    the next document in order of id; after the last comes the first. A null text is empty, a
    single document is its own next, repeated ids follow each other by text, a null id comes first;
    an empty table gives an empty result. One shuffle of the texts.
    """
    schema = (f"{doc_id} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that waits for its next one: (bucket, id, text, fingerprint)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for bucket, lent, key, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if lent and (held is None or held[0] != bucket):
                    continue
                own = digest(np.frombuffer(body.encode(), np.uint8))
                if held is not None:
                    n = len(held[2])
                    raw = (held[2][:n - n // 2] + body[:n // 2]).encode()
                    mixed = digest(np.frombuffer(raw, np.uint8))
                    for col, v in zip(out, (held[1], n, sha(raw), held[3], mixed, likeness(held[3], mixed),
                                            likeness(held[3], own)), strict=True):
                        col.append(v)
                held = None if lent else (bucket, key, body, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
                                                      pa.float64(), pa.float64()), strict=True)],
                names=[doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return neighbours(docs, doc_id, text).select("_bucket", "_borrowed", F.col("_id").cast("long"), "_text").mapInArrow(run, schema)
