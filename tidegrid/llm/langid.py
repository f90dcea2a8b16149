"""Operator 2: language identification.

Multinomial logistic regression on TF-IDF weights of hashed character n-grams, trained by
follow-the-regularised-leader with L1 and L2 penalties, then calibrated by one temperature.
Document frequencies are counted over all documents that may be learned from; weights are fitted to a sample
of about ``per_language`` documents of each language, and about ``most_bytes`` of text over all languages, whatever
the length of their texts. Every language is learned, from one document at least.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; equal scores go to the
language that comes first in sorted order; with nothing to learn from, every text is ``und``; texts of any
length are read whole, in stretches; repeated rows give repeated results; columns other than those named
in a call are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import chosen_by_hash, in_python

DIMENSIONS = 1 << 15
STRETCH = 1 << 18
_letter = regex.compile(r"\p{L}").search
UNKNOWN = "und"


def counts_of(text: str) -> np.ndarray:
    """How often each hashed n-gram of one to three characters of the lower-case text occurs."""
    total = np.zeros(DIMENSIONS, np.int64)
    for start in range(0, len(text), STRETCH):
        part = text[max(0, start - 2) : start + STRETCH].lower()
        c = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        skip = min(2, start)
        pairs = c[:-1] * np.uint32(0x01000193) + c[1:]
        triples = pairs[:-1] * np.uint32(0x01000193) + c[2:]
        grams = np.concatenate([c[skip:] + np.uint32(0x51ED27), pairs[max(0, skip - 1) :], triples])
        total += np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(17), minlength=DIMENSIONS)
    return total


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray  # float32 of each dimension
    weights: np.ndarray  # float32, dimensions x languages
    bias: np.ndarray
    temperature: float

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dimensions and values of the TF-IDF vector, of length 1."""
        at = np.flatnonzero(counts)
        values = (1 + np.log(counts[at])).astype(np.float32) * self.idf[at]
        return at, values / max(float(np.sqrt(values @ values)), 1e-12)

    def probabilities(self, text: str) -> np.ndarray:
        at, values = self.vector(counts_of(text))
        return _softmax((values @ self.weights[at] + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _letter(text):
            return UNKNOWN, 0.0
        p = self.probabilities(text)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Number of texts that hold each dimension, and at the end the number of texts, over all of ``docs``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for text in batch["t"]:
                total[:-1] += counts_of(text or "") > 0
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    rows = in_python(docs.select(F.col(text_col).alias("t")), count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows:  # at most one row per dimension
        out[r["at"]] = r["n"]
    return out


def _chosen(docs: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int, most_bytes: int) -> DataFrame:
    """About ``per_language`` documents of each language, as n-gram counts, chosen by a hash of the id.

    Languages share ``most_bytes`` evenly, so the sample is bounded however many there are; a text of any
    length comes as ``DIMENSIONS`` counts at most. Of each language the document of least hash is always there.
    """
    key = F.col(id_col).cast("string")
    rows = docs.select(key.alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).withColumn("hash", F.xxhash64("id", F.lit(11)))
    totals = rows.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).alias("bytes"), F.min("hash").alias("least"))
    languages = totals.count()
    share = F.least(F.lit(1.0), per_language / F.col("n"), most_bytes / max(1, languages) / F.greatest(F.lit(1), "bytes"))
    chosen = rows.join(F.broadcast(totals.select("lang", "least", share.alias("share"))), "lang")  # a row a language
    chosen = chosen.where(chosen_by_hash(F.col("id"), 11, F.col("share")) | (F.col("hash") == F.col("least")))

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["t"]:
                counts = counts_of(text or "")
                at = np.flatnonzero(counts)
                found.append((at.astype(np.int32), counts[at].astype(np.int32)))
            yield pd.DataFrame({"id": batch["id"], "lang": batch["lang"], "at": [a for a, _ in found], "n": [n for _, n in found]})

    return in_python(chosen.select("id", "lang", "t"), featurise, "id string, lang string, at array<int>, n array<int>")


def _in_order(sample: pd.DataFrame) -> pd.DataFrame:
    return sample.sort_values(["id", "lang"], kind="stable", na_position="first").reset_index(drop=True)


def _sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int, most_bytes: int) -> pd.DataFrame:
    """The sample as the driver would hold it."""
    return _in_order(_chosen(docs, text_col, lang_col, id_col, per_language, most_bytes).toPandas())


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 1000, most_bytes: int = 1 << 24,
    passes: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 7,
) -> LanguageModel:
    """Fit to the rows of ``docs`` that have a language. A fifth of the sample sets the temperature alone.

    One task fits the weights to the bounded sample, and the driver gets the model only.
    """
    known = docs.where(F.col(lang_col).isNotNull())
    frequency = document_frequencies(known, text_col)
    sample = _chosen(known, text_col, lang_col, id_col, per_language, most_bytes)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if parts := [b for b in batches if len(b)]:
            model = fitted(_in_order(pd.concat(parts, ignore_index=True)), frequency, passes, alpha, beta, l1, l2, seed)
            yield pd.DataFrame({"languages": [model.languages], "weights": [model.weights.tobytes()], "bias": [model.bias.tobytes()], "temperature": [model.temperature]})

    row = in_python(sample.repartition(1), fit, "languages array<string>, weights binary, bias binary, temperature double").first()
    if row is None:
        return fitted(pd.DataFrame({"lang": []}), frequency, passes, alpha, beta, l1, l2, seed)
    weights = np.frombuffer(row["weights"], np.float32).reshape(DIMENSIONS, -1)
    return LanguageModel(list(row["languages"]), _idf(frequency), weights, np.frombuffer(row["bias"], np.float32), row["temperature"])


def _idf(frequency: np.ndarray) -> np.ndarray:
    return (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1).astype(np.float32)


def fitted(sample: pd.DataFrame, frequency: np.ndarray, passes: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> LanguageModel:
    """The model of a sample in order."""
    languages = sorted(set(sample["lang"]))
    k = len(languages)
    model = LanguageModel(languages, _idf(frequency), np.zeros((DIMENSIONS, k), np.float32), np.zeros(k, np.float32), 1.0)
    if k == 0:
        return model
    vectors = []
    for at, n in zip(sample["at"], sample["n"]):
        counts = np.zeros(DIMENSIONS, np.int64)
        counts[np.asarray(at, np.int64)] = n
        vectors.append(model.vector(counts))
    target = np.array([languages.index(x) for x in sample["lang"]])
    order = np.random.default_rng(seed).permutation(len(target))
    only = set(np.unique(target, return_index=True)[1].tolist())  # one document of each language is always learned from
    aside = np.array([i for i in order[: len(order) // 5] if i not in only], int)
    learn = np.concatenate([order[len(order) // 5 :], [i for i in order[: len(order) // 5] if i in only]]).astype(int)
    z, n = np.zeros((DIMENSIONS + 1, k)), np.zeros((DIMENSIONS + 1, k))

    def current(at):
        """Weights that follow the regularised leader."""
        zs = z[at]
        shrunk = np.sign(zs) * l1 - zs
        return np.where(np.abs(zs) <= l1, 0.0, shrunk / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(passes):
        for i in learn:
            at, values = np.append(vectors[i][0], DIMENSIONS), np.append(vectors[i][1], 1.0)
            w = current(at)
            error = _softmax(values @ w)
            error[target[i]] -= 1
            gradient = values[:, None] * error
            squared = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / alpha * w
            n[at] += squared
    final = current(np.arange(DIMENSIONS + 1)).astype(np.float32)
    model.weights, model.bias = final[:-1], final[-1]
    if len(aside):
        logits = np.array([vectors[i][1] @ model.weights[vectors[i][0]] + model.bias for i in aside])
        grid = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
        # Targets are smoothed by one pseudo-count, or a sample without errors would ask for certainty.
        aim = np.full(logits.shape, 1 / (len(aside) + 2) / max(1, k - 1))
        aim[np.arange(len(aside)), target[aside]] = 1 - 1 / (len(aside) + 2)
        loss = [-np.mean([a @ np.log(_softmax(row / t) + 1e-300) for row, a in zip(logits, aim)]) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """The kept columns, then lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each dimension and language
    kept = docs.select(*keep)
    rows = docs.select(F.col(text_col).alias("t"), *(c.alias(f"keep{i}") for i, c in enumerate(keep)))
    names = [f"keep{i}" for i in range(len(keep))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch["t"]]
            out = batch[names].copy()
            out["lang_pred"], out["score"] = [x for x, _ in found], [x for _, x in found]
            yield out

    fields = "".join(f"keep{i} {f.dataType.simpleString()}, " for i, f in enumerate(kept.schema))
    out = in_python(rows, run, fields + "lang_pred string, score double")
    return out.select(*(F.col(f"keep{i}").alias(f.name) for i, f in enumerate(kept.schema)), "lang_pred", "score")
