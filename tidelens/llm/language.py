"""Language shares of documents by a mixture of n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BITS = 15           # hash buckets of byte triplets, as a power of two
ROUNDS = 12         # expectation and maximisation steps
PENALTY = 2.0       # log likelihood a further language must bring, times the log of the document's n-grams
LEAST_SHARE = 0.02  # a smaller share is no language of the document
UNKNOWN = "und"
# Letters and bytes of longer characters stay, in lower case; all else is a space.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass
class LanguageModel:
    names: list[str]
    log_p: np.ndarray  # (languages, buckets)


def grams(text: str) -> np.ndarray:
    """Buckets of all byte triplets of the folded text with a space on either side."""
    raw = b" " + text.lower().encode().translate(_FOLD) + b" "
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    key = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    key = key >> np.uint32(32 - BITS)
    return key[~((x[:-2] == 32) & (x[1:-1] == 32))]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """N-gram models of all languages of ``docs``, counted over every whole text.

    Tasks count what they read before the shuffle; the result has a row for each language and
    bucket at most (2**BITS for each value of the closed set of languages). Null texts and
    languages are passed over.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name not in sums:
                    sums[name] = np.zeros(1 << BITS, np.int64)
                sums[name] += np.bincount(grams(body), minlength=1 << BITS)
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                                             names=["lang", "bucket", "n"])

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string"), text)
    rows = (known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
            .groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).orderBy("lang").collect())
    counts = np.full((len(rows), 1 << BITS), 0.2)
    for i, r in enumerate(rows):
        counts[i, r["b"]] += r["n"]
    return LanguageModel([r["lang"] for r in rows], np.log(counts / counts.sum(axis=1, keepdims=True)))


def mixture(p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """(shares, log likelihood) of a document under the given languages, by expectation-maximisation."""
    share = np.full(len(p), 1.0 / len(p))
    total = counts.sum()
    if len(p) > 1:
        for _ in range(ROUNDS):
            share *= p @ (counts / (share @ p)) / total
    return share, float(counts @ np.log(share @ p))


def infer(model: LanguageModel, text: str) -> dict[str, float]:
    """Languages of a text with their shares, largest first; empty where nothing can be said.

    All languages are mixed first; the sets of the one, two, .. largest shares are then refitted, and
    the set grows as long as the penalised likelihood does.
    """
    if not model.names or not any(c.isalpha() for c in text):
        return {}
    counts = np.bincount(grams(text), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    counts = counts[at].astype(np.float64)
    logs = model.log_p[:, at]
    p = np.exp(logs - logs.max(axis=0))  # a factor per n-gram leaves shares and differences as they are
    full, _ = mixture(p, counts)
    order = np.argsort(-full, kind="stable")
    price = PENALTY * np.log(counts.sum() + 1)
    single = logs @ counts - (logs.max(axis=0) @ counts)
    best = [int(single.argmax())]
    share, gain = np.ones(1), float(single.max())
    for k in range(2, len(order) + 1):
        own = order[:k]
        if full[own[-1]] < LEAST_SHARE:
            break
        new, likelihood = mixture(p[own], counts)
        if likelihood - (k - 1) * price <= gain:
            break
        best, share, gain = own.tolist(), new, likelihood - (k - 1) * price
    return dict(sorted(((model.names[i], float(s)) for i, s in zip(best, share, strict=True)), key=lambda x: (-x[1], x[0])))


def detect(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred, score (its share) and languages (map of all shares). No shuffle.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, or where nothing
    was learnt. Every whole text is read; repeated rows stay, an empty table gives an empty result;
    the three names replace columns of these names.
    """
    new = ("lang_pred", "score", "languages")
    kept = [c for c in docs.columns if c not in new]
    schema = (docs.select(*kept).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0))
              .withColumn("languages", F.create_map(F.lit(""), F.lit(0.0))).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [infer(model, t) if t else {} for t in batch.column(kept.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([next(iter(f), UNKNOWN) for f in found], pa.string()),
                 pa.array([next(iter(f.values()), 0.0) for f in found], pa.float64()),
                 pa.array([list(f.items()) for f in found], pa.map_(pa.string(), pa.float64()))], names=[*kept, *new])

    return docs.select(*kept).mapInArrow(run, schema)
