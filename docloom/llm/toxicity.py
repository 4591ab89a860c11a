"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's score is the logistic of a weighted sum of its distinct words and their first letters; a document's is the
noisy-or of its sentences, ``1 - prod(1 - p)``. Only documents have labels, so the weights are trained
through the noisy-or: its gradient goes to the sentences that explain the label. The trained weights
then score every sentence of every document, which locates the offending ones.

A sentence of a document of n sentences starts from odds n times smaller: sentences without evidence add up to
the same, however many there are, so that clean texts do not become toxic by being long.

Training uses at most ``PER_CLASS`` labelled documents of each label, the first in hashed order, of
at most ``TRAIN_BYTES`` each; labels are matched to all documents before the sample is taken.
Scoring covers every document and its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PER_CLASS = 1500
TRAIN_BYTES = 20_000
PREFIXES = (4, 5, 6)
MIN_DOCS = 5
MIN_Z = 5.0
MIN_GAP = 0.02
EPOCHS = 150
RATE = 0.15
L1 = 2e-4
FOLDS, HELD_OUT = 5, 0

_SENTENCE = re.compile(r"[.!?\n]+")
_TOKEN = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences: runs between full stops, exclamation and question marks and line ends."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def features(word: str) -> tuple[str, ...]:
    """The word and, for its inflections, its first letters."""
    return (word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(sample: pd.DataFrame, epochs: int = EPOCHS) -> tuple[dict[str, float], float]:
    """Word weights and bias from columns text and toxic (0 or 1). Empty without both labels: (no words, rare-event bias)."""
    sample = sample.drop_duplicates("text")
    labels = sample["toxic"].to_numpy(dtype=float)
    if len(set(labels)) < 2:
        return {}, (-6.0 if not len(labels) or labels[0] == 0 else 6.0)
    vocab: dict[str, int] = {}
    bags, seen = [], {}
    for n, text in enumerate(sample["text"]):
        bag = [{vocab.setdefault(f, len(vocab)) for w in set(_TOKEN.findall(text[a:z].lower())) for f in features(w)} for a, z in sentences(text)]
        bags.append([b for b in bag if b])
        for w in set().union(*bags[-1]):
            seen.setdefault(w, []).append(n)
    # Words whose share of documents differs between the labels by no more than chance tell nothing.
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    keep: dict[int, int] = {}
    for w, own in sorted(seen.items()):
        k1 = labels[own].sum()
        both = len(own) / len(labels)
        z = (k1 / n1 - (len(own) - k1) / n0) / np.sqrt(max(both * (1 - both), 1e-9) * (1 / n1 + 1 / n0))
        if len(own) >= MIN_DOCS and abs(z) >= MIN_Z and abs(k1 / n1 - (len(own) - k1) / n0) >= MIN_GAP:
            keep[w] = len(keep)
    word, sent, doc_of, n_sent = [], [], [], 0
    for n, bag in enumerate(bags):
        for b in bag:
            own = [keep[w] for w in b if w in keep]
            word += own
            sent += [n_sent] * len(own)
            doc_of.append(n)
            n_sent += 1
    word, sent, doc_of = np.array(word, int), np.array(sent, int), np.array(doc_of, int)
    has = np.bincount(doc_of, minlength=len(labels)) > 0 if n_sent else np.zeros(len(labels), bool)
    cost = has / max(has.sum(), 1)
    prior = -np.log(np.bincount(doc_of, minlength=len(labels)))[doc_of]
    w, b = np.zeros(len(keep)), -3.0
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    for t in range(1, epochs + 1):
        z = b + prior + np.bincount(sent, w[word], minlength=n_sent)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(labels))
        doc_p = np.clip(-np.expm1(log_none), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p for a clean document, -p (1 - P) / P for a toxic one.
        g = np.where(labels == 1, -(1 - doc_p) / doc_p, 1.0)[doc_of] * p * cost[doc_of]
        grad = np.append(np.bincount(word, g[sent], minlength=len(keep)), g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - L1 * RATE * 10, 0.0)
        b = min(b - step[-1], -1.0)
    name = {i: word for word, i in vocab.items()}
    return {name[k]: float(w[i]) for k, i in keep.items() if abs(w[i]) > 0.05}, float(b)


class _Weights(dict):
    """Summed weights of words as they come up; starts anew beyond ``limit`` words."""

    def __init__(self, weights: dict[str, float], limit: int = 400_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        got = self[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return got


def sentence_scores(text: str | None, weights: _Weights, bias: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    if not text:
        return [], np.zeros(0)
    spans = [(a, e) for a, e in sentences(text) if _TOKEN.search(text, a, e)]
    z = np.array([sum({f: weights[f] for f in _TOKEN.findall(text[a:e].lower())}.values()) for a, e in spans])
    z = z + bias - np.log(max(len(spans), 1))
    return spans, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, train_bytes: int = TRAIN_BYTES) -> tuple[dict[str, float], float]:
    """Train on documents outside the held-out fold. Conflicting or null labels of a document: the larger one, nulls ignored.

    Of texts that share an id the one with the least hash is learned from.
    """
    gold = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    gold = gold.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # Which documents are drawn is decided on narrow rows; texts are read for those alone.
    narrow = docs.select("doc_id", F.octet_length("text").alias("n")).filter(F.col("n").between(1, train_bytes)).select("doc_id").distinct()
    gold = narrow.join(gold, "doc_id")
    drawn = C.drawn(gold, "toxic", per_class, 2)
    if drawn is None:
        return train(pd.DataFrame({"text": [], "toxic": []}))
    drawn = F.broadcast(drawn)  # at most 2 * per_class rows
    sample = docs.select("doc_id", "text").join(drawn, "doc_id").filter(F.octet_length("text").between(1, train_bytes))
    sample = sample.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("one"))
    return train(sample.select("doc_id", "one.text", "one.toxic").toPandas().sort_values("doc_id", ignore_index=True))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, start, end, worst.

    ``start`` and ``end`` are code points of the sentence with the largest score ``worst``. A null or
    empty text has no sentences: its score is that of no evidence, 0. A null doc_id is kept and not
    held out. Without labels of both kinds every score comes from a fixed bias. Extra columns are ignored.
    """
    weights, bias = fit(docs, labels)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Weights(weights)
        for part in parts:
            out = []
            for text in part["text"]:
                spans, p = sentence_scores(text, known, bias)
                k = int(p.argmax()) if len(p) else -1
                none = float(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
                out.append((float(-np.expm1(none)) + 0.0, *(spans[k] if k >= 0 else (0, 0)), float(p[k]) if k >= 0 else 0.0))
            yield pd.concat([part[["doc_id", "held_out"]].reset_index(drop=True), pd.DataFrame(out, columns=["score", "start", "end", "worst"])], axis=1)

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    rows = rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, start int, end int, worst double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select("doc_id", "held_out", "score", "predicted", "start", "end", "worst")


def op4_multiple_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
