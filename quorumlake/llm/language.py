"""Language identification by mixtures.

A document's n-grams (3 UTF-8 bytes, A-Z lowered, hashed) are drawn from a
mixture of languages; expectation-maximisation estimates the proportions. Sets
of languages are compared by likelihood, less half a logarithm of the number
of n-grams for each language beyond the first, and the set's largest language
is the prediction. Its score is its proportion times the share of the n-grams
that training met in that language.

Training counts all n-grams of all training documents: language given, and
crc32 of the id's text not 2 modulo 4. A prediction reads the text alone.
Rows: `und` with score 0 if the text is null or has no letter, or nothing was
learned; ties go to the smaller language name.

The model has 2^15 numbers a language; it is the only thing that is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import _text as T
from ._store import table

BUCKETS = 1 << 15
SMOOTHING = 0.5
STEPS = 25
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def trigrams(buf: np.ndarray) -> np.ndarray:
    """Buckets of the 3-byte grams of one text; a space stands before and after it."""
    low = np.empty(len(buf) + 2, np.uint32)
    low[0] = low[-1] = 32
    low[1:-1] = T.LOWER[buf]
    low[(low >= 9) & (low <= 13)] = 32
    if len(low) < 3:
        return np.empty(0, np.int64)
    return ((((low[:-2] << 16) | (low[1:-1] << 8) | low[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """Languages ascending; their log-probabilities of buckets; which buckets training met."""

    langs: list[str]
    logp: np.ndarray
    met: np.ndarray

    def proportions(self, logp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Mixture proportions and log-likelihood, given log-probabilities (gram, language) and counts."""
        top = logp.max(1, keepdims=True)
        p, total = np.exp(logp - top), n.sum()
        pi = np.full(logp.shape[1], 1 / logp.shape[1])
        for _ in range(STEPS if len(pi) > 1 else 0):
            new = pi * ((n / (p @ pi)) @ p) / total
            moved = np.abs(new - pi).max()
            pi = new
            if moved < 1e-3:
                break
        return pi, float(n @ (np.log(p @ pi) + top[:, 0]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        count = np.bincount(trigrams(np.frombuffer(text.encode(), np.uint8)), minlength=BUCKETS)
        at = np.flatnonzero(count)
        n, logp = count[at].astype(np.float64), self.logp[at]
        single = n @ logp
        best_set, best_pi = [int(np.argmax(single))], np.ones(1)
        if len(self.langs) > 1:
            pi, _ = self.proportions(logp, n)
            order = np.argsort(-pi, kind="stable")
            cost, best = 0.5 * np.log(n.sum() + 1), float(single.max())
            for k in range(2, len(order) + 1):
                if pi[order[k - 1]] < 0.01:
                    break
                chosen = np.sort(order[:k])
                part, like = self.proportions(logp[:, chosen], n)
                if like - (k - 1) * cost <= best:
                    break
                best, best_set, best_pi = like - (k - 1) * cost, chosen.tolist(), part
        k = int(np.argmax(best_pi))
        lang = best_set[k]
        return self.langs[lang], float(min(1.0, best_pi[k]) * n[self.met[at, lang]].sum() / n.sum())


def train(docs: DataFrame) -> Model:
    """Counts the n-grams of all training documents; a row a language and bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in T.slices(batches, "_text"):
            buf, off = T.buffers(batch.column(1))
            for i, lang in enumerate(batch.column(0).to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(buf[off[i] : off[i + 1]]), minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").alias("_lang"), F.col("text").alias("_text"))
    got = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    seen = np.zeros((BUCKETS, len(langs)))
    seen[got["bucket"].to_numpy(int), [langs.index(x) for x in got["lang"]]] = got["n"].to_numpy(float)
    logp = np.log((seen + SMOOTHING) / (seen.sum(0, keepdims=True) + SMOOTHING * BUCKETS))
    return Model(langs, logp, seen > 0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, with lang_pred and score (these names, in any case, replace columns of docs).

    Repeated rows are predicted alike; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    place = keep.index("text")
    plain = docs.select(*[F.col(f"`{c}`") for c in keep]).toDF(*[f"c{k}" for k in range(len(keep))])  # mapInArrow can't resolve a name with a dot
    out = StructType([*plain.schema, StructField("p", StringType()), StructField("s", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, f"c{place}"):
            got = [model.predict(x) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*batch.schema.names, "p", "s"])

    return plain.mapInArrow(run, out).toDF(*keep, "lang_pred", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
