"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of 1 to 3 characters, of letters in lower case with runs of all else as one space, are hashed into DIMENSIONS. Term
frequencies are damped by a logarithm, weighed by inverse document frequency and scaled to length one. The weights are learnt by
follow-the-regularised-leader with an elastic net, which leaves most of them zero; then a temperature on a part of the sample that
the weights have not seen calibrates the scores.

It is fitted on the driver on a sample of at most MAX_PER_LANGUAGE documents a language, and MAX_SAMPLE of all, but LEAST a language; a text over
MAX_TRAIN_CHARS characters gives so many, in pieces from all over it (parameters). All languages that labels name are learnt.

Defined cases: a text that is null or has no letter is `und` with score 0. With no labelled row every document is `und`. Rows
repeated keep a row each; of equal labelled rows one is learnt from. Empty tables give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.base import is_held_out, map_texts, sampled, table

MAX_PER_LANGUAGE, MAX_SAMPLE, LEAST, MAX_TRAIN_CHARS = 600, 60_000, 8, 6000
DIMENSIONS, SIZES = 1 << 14, (1, 2, 3)
#: Code points hashed at once, so that a long text needs no long array.
CHUNK = 1 << 16
OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """How often each dimension occurs in the whole text."""
    codes = np.frombuffer((" " + OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(DIMENSIONS, np.int64)
    most = max(SIZES)
    for at in range(0, len(codes), CHUNK):
        part = codes[at : at + CHUNK + most - 1]
        own = min(CHUNK, len(codes) - at)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, most + 1):
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
            if n in SIZES:
                mixed = h[:own] ^ (h[:own] >> np.uint32(15))
                counts += np.bincount((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(18), minlength=DIMENSIONS)
            if len(part) <= n:
                break
    return counts


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The dimensions that occur and their weights, of length one."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.idf, self.bias, self.temperature = languages, idf, bias, temperature
        self.used = np.flatnonzero(weights.any(axis=1))  # the elastic net leaves the others at zero
        self.weights = weights

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            if text is None or not has_letter(text):
                names.append("und")
                scores.append(0.0)
                continue
            at, x = vector(text, self.idf)
            z = (x @ self.weights[at] + self.bias) / self.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            names.append(self.languages[int(p.argmax())])
            scores.append(float(p.max()))
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05, seed: int = 3) -> LanguageModel | None:
    """FTRL-proximal, one document a step; a fifth of the sample is kept for the temperature."""
    kept = [i for i, t in enumerate(texts) if has_letter(t)]
    if not kept:
        return None
    texts, labels = [texts[i] for i in kept], [labels[i] for i in kept]
    languages = sorted(set(labels))
    y = np.array([languages.index(k) for k in labels])
    order = np.random.default_rng(seed).permutation(len(texts))
    fit, hold = order[len(order) // 5 :], order[: len(order) // 5]
    frequency = np.zeros(DIMENSIONS)
    for i in fit:
        frequency[np.flatnonzero(gram_counts(texts[i]))] += 1
    idf = np.log((1 + len(fit)) / (1 + frequency)) + 1
    rows = [vector(t, idf) for t in texts]
    k = len(languages)
    z, n = np.zeros((DIMENSIONS + 1, k)), np.zeros((DIMENSIONS + 1, k))  # the last row is the bias

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for epoch in range(epochs):
        for i in np.random.default_rng(seed + epoch).permutation(fit):
            at, x = np.r_[rows[i][0], DIMENSIONS], np.r_[rows[i][1], 1.0]
            w = weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(DIMENSIONS + 1))
    held = hold if len(hold) else fit
    logits = np.stack([rows[i][1] @ w[rows[i][0]] + w[-1] for i in held])
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
    return LanguageModel(languages, idf, w[:-1].astype(np.float32), w[-1], float(grid[int(np.argmin(loss))]))


def training_rows(documents: DataFrame, max_per_language: int = MAX_PER_LANGUAGE, max_chars: int = MAX_TRAIN_CHARS) -> tuple[list[str], list[str]]:
    """The sample: of each language the documents that come first by hash, held-out ids left out."""
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out())
    known = labelled.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("count")).orderBy("lang").collect()  # one row a language
    if not counts:
        return [], []
    most = max(LEAST, min(max_per_language, MAX_SAMPLE // len(counts)))
    # a hash threshold by language that leaves about twice the sample; then the first by hash, in one scan for all languages
    shares = {r["lang"]: min(1.0, (2.0 * most + 64) / r["count"]) for r in counts}
    bound = F.create_map(*[F.lit(x) for lang, share in shares.items() for x in (lang, int(-(2**63) + share * (2**64 - 2)) if share < 1 else 2**63 - 1)])
    few = known.where(F.col("h") <= F.try_element_at(bound, F.col("lang"))).withColumn("text", sampled(F.col("text"), max_chars))
    few = few.groupBy("lang", "h").agg(F.min("text").alias("text"))  # rows that repeat would crowd out the others
    rows = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= most).orderBy("lang", "r").select("text", "lang").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(df: DataFrame, model: LanguageModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred and score."""

    def compute(texts: list) -> dict:
        names, scores = model.predict(texts) if model else (["und"] * len(texts), [0.0] * len(texts))
        return {"lang_pred": names, "score": scores}

    return map_texts(df, text, "lang_pred string, score double", compute, list(keep))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identify(documents, train(*training_rows(documents)))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
