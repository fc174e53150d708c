"""Language ID by error-correcting output codes over hashed character n-grams.

Each language has a codeword; for each bit a linear n-gram classifier says on which side
of that bit a text lies. Decoding sums, over the bits, the logistic loss of the
classifier's margin against the codeword's bit, weighted by how reliable the classifier
was in training, and picks the codeword with the least loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import base, worker

FEATURES = 1 << 12
UNKNOWN = "und"


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the identifier as text, modulo ``parts``; a null identifier counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text)) if text else False


def ngram_features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-grams of the whole text, in lower case."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    code = np.concatenate([np.array([32], np.uint32), code, np.array([32], np.uint32)])
    gram, buckets = np.zeros_like(code), []
    for n in range(3):
        gram = (gram[: len(code) - n] if n == 0 else gram[:-1] * np.uint32(0x01000193)) ^ (code[n:] * np.uint32(0x9E3779B1))
        if len(gram):
            buckets.append(((gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(20))
    count = np.bincount(np.concatenate(buckets), minlength=FEATURES)[:FEATURES]
    return np.sqrt(count / max(1, count.sum())).astype(np.float32)


def codewords(classes: int, seed: int = 11) -> np.ndarray:
    """(classes, bits) of -1 and 1: all distinct splits for few classes, else the best of many random codes."""
    if classes <= 1:
        return np.ones((classes, 1), dtype=np.int8)
    if classes <= 5:
        # Exhaustive code: every way to part the classes in two, the first class always on the same side.
        splits = np.arange(1, 1 << (classes - 1))
        return np.array([[1] * len(splits)] + [[-1 if s >> k & 1 else 1 for s in splits] for k in range(classes - 1)], dtype=np.int8)
    rng, bits = np.random.Generator(np.random.PCG64(seed)), int(np.ceil(10 * np.log2(classes)))
    best, best_apart = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(classes, bits))
        apart = (bits - (code.astype(int) @ code.T.astype(int) - bits * np.eye(classes, dtype=int) * 2)) // 2
        if (nearest := apart.min()) > best_apart and (abs(code.sum(axis=0)) < classes).all():
            best, best_apart = code, nearest
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (FEATURES, bits)
    bias: np.ndarray
    trust: np.ndarray = field(default_factory=lambda: np.ones(1))
    sharpness: float = 1.0

    def losses(self, x: np.ndarray) -> np.ndarray:
        """(texts, languages) weighted losses."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0.0, -margin[:, None, :] * self.code[None, :, :])
        return (loss * self.trust).sum(axis=2)

    def predict(self, texts: list[str | None], ambiguous_below: float = 0.6) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether the two best codewords are too close to tell."""
        lang, score, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        own = [i for i, t in enumerate(texts) if has_letter(t)]
        if own and self.languages:
            loss = self.losses(np.stack([ngram_features(texts[i]) for i in own])) * self.sharpness
            p = np.exp(loss.min(axis=1, keepdims=True) - loss)
            p /= p.sum(axis=1, keepdims=True)
            for i, row, best in zip(own, p, p.argmax(axis=1), strict=True):
                lang[i], score[i], unsure[i] = self.languages[best], min(1.0, float(row[best])), bool(row[best] < ambiguous_below)
        return lang, score, unsure


def train(x: np.ndarray, lang: list[str], steps: int = 300, rate: float = 2.0, penalty: float = 1e-6) -> LanguageModel:
    """Fit the binary classifiers by gradient descent with momentum; languages weigh the same whatever their rows."""
    languages = sorted(set(lang))
    code = codewords(len(languages))
    if len(languages) <= 1:
        return LanguageModel(languages, code, np.zeros((FEATURES, 1)), np.ones(1), np.ones(1))
    y = np.array([languages.index(v) for v in lang])
    target = code[y].astype(np.float32)
    share = 1.0 / np.bincount(y)[y] / len(languages)
    share = share.astype(np.float32)[:, None]
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    rate *= 20.0
    for _ in range(steps):
        g = -target * share / (1.0 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        vw = 0.9 * vw - rate * (x.T @ g + penalty * w)
        vb = 0.9 * vb - 0.1 * rate * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = ((x @ w + b) * target > 0).astype(np.float64)
    accuracy = np.clip((right * share).sum(axis=0), 0.5, 0.999)
    trust = np.log(accuracy / (1 - accuracy))
    trust = trust / trust.sum() * len(trust) if trust.sum() > 0 else np.ones(len(trust))
    return LanguageModel(languages, code, w.astype(np.float64), b.astype(np.float64), trust)


def fit(docs: DataFrame, sample_per_language: int = 800, sample_in_all: int = 20_000, seed: int = 5) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang): rows with a language and a letter.

    The classifiers are fitted on a bounded sample: about ``sample_per_language`` rows of
    each language and ``sample_in_all`` rows of all, chosen by a hash of doc_id. Language
    counts cover all rows. Only the sample's hashed features reach the driver.
    """
    spark = docs.sparkSession
    base.ship(spark)
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = base.materialize(labelled.groupBy("lang").count(), "languages")
    languages = counts.count()
    per_language = min(sample_per_language, sample_in_all / max(1, languages))
    pick = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < F.lit(1_000_000.0 * per_language) / F.col("count")

    def features(batches):
        worker.enter("language")
        for batch in batches:
            rows = [(lang, ngram_features(t).astype(np.float16).tobytes()) for t, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "x"])

    sample = labelled.join(F.broadcast(counts) if languages <= 10_000 else counts, "lang").where(pick).select("text", "lang").mapInArrow(features, "lang string, x binary").collect()
    sample.sort()
    if not sample:
        return LanguageModel([], codewords(0), np.zeros((FEATURES, 1)), np.zeros(1))
    return train(np.stack([np.frombuffer(r["x"], dtype=np.float16) for r in sample]).astype(np.float32), [r["lang"] for r in sample])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every text of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything
    when nothing was learned; equal texts get equal results; other columns are ignored;
    an empty table gives no rows.
    """
    base.ship(docs.sparkSession)

    def run(batches):
        worker.enter("language")
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 512):
                lang, score, unsure = model.predict(texts.slice(at, 512).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned from four of five folds."""
    docs = base.table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
