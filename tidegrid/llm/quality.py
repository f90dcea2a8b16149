"""Operator 4: quality classifier, a convolutional network over bytes in numpy.

Filters slide over the bytes of overlapping chunks that cover the whole text. Each chunk keeps the maximum
of each filter; the maxima are combined over the chunks by their largest and their mean; a logistic unit
makes one probability of both. Trained by gradient descent (Adam) on a bounded sample of labelled texts.

Defined cases: null and empty texts are scored like any other, as a text without bytes (all maxima 0);
a text without a label is scored but not learned from; a document with several labels is learned from once
per label; with no label at all the score is 0.5; texts of any length are scored whole, in blocks;
repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import chosen_by_hash, in_python

WIDTH, FILTERS = 8, 16
CHUNK, STEP = 256, 192
BLOCK = STEP * 512


def _bytes(text: str | None) -> np.ndarray:
    """Bytes of the text with padding, so that every filter has at least one place."""
    return np.frombuffer((text or "").encode("utf-8", "replace") + b"\x00" * WIDTH, np.uint8)


@dataclass
class ByteConvolution:
    table: np.ndarray  # float32, WIDTH x 256 x FILTERS: what a byte at a place of the filter adds
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # weights of the largest and of the mean of each filter
    out_bias: float

    def responses(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - WIDTH + 1
        total = self.table[0][data[:n]]
        for k in range(1, WIDTH):
            total += self.table[k][data[k : k + n]]
        return total

    def chunk_maxima(self, text: str | None) -> np.ndarray:
        """Largest response of each filter in each chunk, after bias and rectifier."""
        data = _bytes(text)
        places = len(data) - WIDTH + 1
        found = []
        for start in range(0, places, BLOCK):
            part = self.responses(data[start : start + BLOCK + CHUNK - STEP + WIDTH - 1])
            begins = np.arange(0, min(BLOCK, places - start), STEP)
            edges = np.empty(2 * len(begins), np.intp)
            # A row of -inf at the end, so that every chunk has a place after its last.
            part = np.concatenate([part, np.full((1, part.shape[1]), -np.inf, part.dtype)])
            edges[::2], edges[1::2] = begins, np.minimum(begins + CHUNK, len(part) - 1)
            found.append(np.maximum.reduceat(part, edges, axis=0)[::2])
        return np.maximum(np.concatenate(found) + self.bias, 0)

    def score(self, text: str | None) -> float:
        m = self.chunk_maxima(text)
        z = float(np.concatenate([m.max(axis=0), m.mean(axis=0)]) @ self.out) + self.out_bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(texts: list[str | None], labels: list[int], passes: int = 10, batch: int = 24, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> ByteConvolution:
    rng = np.random.default_rng(seed)
    model = ByteConvolution(
        rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), 0.0,
    )
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        model.out[:] = 0
        model.out_bias = 0.0 if not len(y) else (3.0 if y[0] else -3.0)
        return model
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    log_odds = float(np.log(y.mean() / (1 - y.mean())))
    data = [_bytes(t) for t in texts]
    params = [model.table, model.bias, model.out, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    columns = np.arange(FILTERS)
    steps = 0
    for _ in range(passes):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            grads = [np.zeros_like(p) for p in params]
            for i in order[at : at + batch]:
                r = model.responses(data[i])
                begins = range(0, len(r), STEP)
                where = np.array([b + r[b : b + CHUNK].argmax(axis=0) for b in begins])
                m = r[where, columns] + model.bias
                on = np.maximum(m, 0)
                top = on.argmax(axis=0)
                features = np.concatenate([on[top, columns], on.mean(axis=0)])
                p = 1 / (1 + np.exp(-np.clip(features @ model.out + params[3][0], -40, 40)))
                g = float((p - y[i]) * weight[i] / batch)
                grads[2] += g * features
                grads[3] += g
                back = np.repeat((g * model.out[FILTERS:] / len(on))[None], len(on), axis=0)
                back[top, columns] += g * model.out[:FILTERS]
                back *= m > 0
                grads[1] += back.sum(axis=0)
                for k in range(WIDTH):
                    np.add.at(grads[0][k], (data[i][where + k], columns[None]), back)
            steps += 1
            grads[0] += decay * params[0]
            for p, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.999**steps)) + 1e-8)
    model.out_bias = float(params[3][0]) + log_odds  # fitted to balanced classes; scores follow the sample's
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """(text, label) of about ``per_class`` documents of each class, chosen by a hash of the id.

    The number of documents of each class is kept in column ``total``, so that a fit can undo the balance. Labels that
    repeat count once. Texts over ``most_bytes`` are not learned from: together both bounds limit what the driver holds.
    """
    rows = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).distinct()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = F.create_map(*(F.lit(x) for k in (0, 1) for x in (k, min(1.0, per_class / max(1, sizes.get(k, 0))))))
    rows = rows.where(chosen_by_hash(F.col("id").cast("string"), 13, share[F.col("label")]))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    out = texts.join(F.broadcast(rows), "id").toPandas()  # about ``per_class`` ids of each class
    out["total"] = out["label"].map(sizes)
    return out.sort_values(["id", "label", "text"], kind="stable").reset_index(drop=True)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, most_bytes: int = 1 << 16, **fit_options) -> ByteConvolution:
    """Fit to documents with a label; pass only those that may be learned from."""
    sample = labelled_sample(docs, labels, label, per_class, most_bytes)
    model = fit(sample["text"].tolist(), sample["label"].tolist(), **fit_options)
    if sample["label"].nunique() == 2:
        here, there = sample["label"].mean(), sample.drop_duplicates("label").set_index("label")["total"]
        model.out_bias += float(np.log(there[1] / there[0]) - np.log(here / (1 - here)))
    return model


def score(docs: DataFrame, model, text_col: str = "text", keep: tuple[Column, ...] = (), threshold: float = 0.3) -> DataFrame:
    """The kept columns, score, and predicted (1 from ``threshold`` on) of every row; ``model`` has a method score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kept = docs.select(*keep)
    rows = docs.select(F.col(text_col).alias("t"), *(c.alias(f"keep{i}") for i, c in enumerate(keep)))
    names = [f"keep{i}" for i in range(len(keep))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            out["score"] = np.array([shared.value.score(t) for t in batch["t"]], float)
            out["predicted"] = (out["score"] >= threshold).astype("int32")
            yield out

    fields = "".join(f"keep{i} {f.dataType.simpleString()}, " for i, f in enumerate(kept.schema))
    out = in_python(rows, run, fields + "score double, predicted int")
    return out.select(*(F.col(f"keep{i}").alias(f.name) for i, f in enumerate(kept.schema)), "score", "predicted")
