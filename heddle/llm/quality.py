"""Quality classifier from weak labels.

1. Overlapping heuristics vote good, bad or nothing on each document of the corpus. The corpus is
   then a table of vote patterns with counts of different texts, of 4 ** (number of heuristics) rows at most, which is
   all that comes to the driver of it.
2. Expectation-maximisation over these counts estimates, without any label, how often documents
   are good and how each heuristic votes on good and on bad ones, and so each pattern's posterior.
3. The posteriors are the targets of a logistic scorer that is linear in hashed features: byte
   trigrams of the text and quantised repetition counts. It is fitted on ``fit_documents``
   documents at most, half of them from the different texts that the votes call bad and half from the others, drawn by hash, each
   text once: rare junk is in it, and a text that most rows have counts once. Each half is weighted back to its share of
   the different texts, but bad ones to ``LEAST_BAD`` at least. The scorer sees what the heuristics do not count, decides where they
   don't vote, and scores every document.

A null text is an empty one. A text without words scores 0. Where the votes call no text bad, or none good, there are no two kinds to
tell apart, and all texts with words are kept. Ids may be null or repeat; each
row is scored alone, copies and ties alike. A text of any length is scored whole, in one task. No rows give no
rows. ``score`` reads no other columns; ``keep_good`` passes them through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import filled, map_batches, materialise, texts

#: Documents that the scorer is fitted on, the bound on what is gathered for it.
FIT_DOCUMENTS = 4000
#: Hashed features; the last ones are for repetition.
DIMENSIONS, EXTRA, MARK = 4096, 64, 0.3
EM_ROUNDS, EM_END = 200, 1e-9
STEPS, RATE, DECAY, BLOCK = 150, 0.5, 1e-4, 500
KEEP = 0.5
#: The weight of bad texts in the fit is their share of the different texts, or this, so that rare ones are learnt too.
LEAST_BAD = 0.05

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "a al and as at aus be by con das de del den der des die du ein el elle en es et for from für he im in is it la las le les lo los mit of on or ou par para pas pour que qui se sur te that the this to un una une und von was with y zu".split()
)
SENTENCE_END = re.compile(r"[.!?]+(?:\s|$)")

#: A vote of a heuristic that a text gives too little to go by. It says nothing of the text.
NONE = 2
SHORT = 12
#: Words among which different ones are counted, so that long texts are judged as short ones are.
WINDOW = 400
HEURISTICS = ("symbols", "capitals", "adjacent", "function_words", "sentences", "exclamation", "separators", "vocabulary")


def votes(text: str) -> tuple[int, ...]:
    """Of each heuristic: 1 good, -1 bad, 0 neither, NONE if it can't tell. Kinds of junk exclude each other, so one that
    sees no junk of its kind has no opinion."""
    words = text.split()
    n = len(words)
    if n < 3:
        return (NONE,) * len(HEURISTICS)
    seen = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper = int(seen[65:91].sum())
    lower = int(seen[97:123].sum())
    marks = int(seen[[35, 36, 37, 38, 42, 64, 94, 126]].sum())
    against = lambda value, bad: -1 if value >= bad else 0
    adjacent = sum(map(eq, words, words[1:])) / (n - 1)
    function = sum(map(FUNCTION_WORDS.__contains__, words)) / n
    length = n / max(sum(1 for _ in SENTENCE_END.finditer(text)), 1)
    return (
        against(marks / n, 0.15),
        against(upper / max(upper + lower, 1), 0.3),
        against(adjacent, 0.1),
        1 if function >= 0.12 else NONE if n < SHORT else -1 if function <= 0.02 and n >= 20 else 0,
        1 if 3 <= length <= 40 else NONE if n < SHORT else -1 if length >= 80 else 0,
        against(int(seen[33]) / n, 0.1),
        against(int(seen[124]) / n, 0.05),
        NONE if n < 30 else -1 if variety(words) < 0.2 else 0,
    )


def variety(words: list[str]) -> float:
    """Different words as a share of all, in windows of WINDOW words; the last one ends with the text."""
    n = len(words)
    starts = [*range(0, max(n - WINDOW, 0), WINDOW), max(n - WINDOW, 0)]
    return sum(len(set(words[k : k + WINDOW])) for k in starts) / (len(starts) * max(min(n, WINDOW), 1))


@dataclass
class LabelModel:
    """P(good) and, by heuristic and class (bad, good), P(vote) for votes -1, 0, 1, given that
    there is one."""

    prior: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | votes) for rows of votes."""
        if not len(patterns):
            return np.zeros(0)
        logs = np.log(np.concatenate([self.table, np.ones((*self.table.shape[:2], 1))], axis=2))
        logs = logs[np.arange(patterns.shape[1]), :, patterns + 1].sum(axis=1)
        bad, good = logs[:, 0] + np.log(1 - self.prior), logs[:, 1] + np.log(self.prior)
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def estimate(patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Expectation-maximisation from a start where most heuristics are right more often than not."""
    n, m = patterns.shape
    model = LabelModel(0.8, np.tile(np.array([[0.35, 0.5, 0.15], [0.02, 0.48, 0.5]]), (m, 1, 1)))
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(EM_ROUNDS):
        good = model.posterior(patterns)
        weight = np.stack([(1 - good) * counts, good * counts])
        table = np.einsum("cn,nmv->mcv", weight, one_hot) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        prior = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6))
        change = np.abs(table - model.table).max() + abs(prior - model.prior)
        model = LabelModel(prior, table)
        if change < EM_END:
            break
    return model


def features(text: str) -> np.ndarray:
    """Hashed features of a text with words: counts of trigrams, then marks for repetition."""
    b = np.frombuffer(b" " + text.encode() + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    trigrams = np.bincount(h >> np.uint32(20), minlength=DIMENSIONS)[:DIMENSIONS].astype(np.float32)
    words = text.split()
    n, extra = len(words), np.zeros(EXTRA, np.float32)
    extra[int(15 * sum(map(eq, words, words[1:])) / max(n - 1, 1))] = 1
    extra[16 + int(15 * variety(words))] = 1
    extra[32 + min(15, n.bit_length())] = 1
    lines = text.split("\n")
    extra[48 + int(15 * (1 - len(set(lines)) / len(lines)))] = 1
    return np.concatenate([trigrams, extra])


def scaled(found: np.ndarray) -> np.ndarray:
    """Rows of features with trigrams of length 1, as the scorer takes them."""
    out = np.atleast_2d(found).astype(np.float32)
    out[:, :DIMENSIONS] /= np.maximum(np.sqrt((out[:, :DIMENSIONS] ** 2).sum(axis=1, keepdims=True)), 1e-9)
    out[:, DIMENSIONS:] *= MARK
    return out


def compact(found: np.ndarray) -> bytes:
    """Features in a byte each, for the sample: counts relative to the largest where that is more
    than a byte holds."""
    counts = found.copy()
    most = counts[:DIMENSIONS].max(initial=0)
    if most > 255:
        counts[:DIMENSIONS] = np.ceil(counts[:DIMENSIONS] * (255 / most))
    return counts.astype(np.uint8).tobytes()


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        """Probability that a text is good."""
        if not text.strip():
            return 0.0
        return float(1 / (1 + np.exp(np.clip(-(scaled(features(text))[0] @ self.weights + self.bias), -50, 50))))


def train(found: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None) -> Scorer:
    """Logistic regression of soft targets on rows of ``compact`` features, by gradient descent with
    momentum. Rows are widened a block at a time, so that the driver holds a byte a feature."""
    n = len(found)
    weight = np.full(n, 1 / max(n, 1)) if weight is None else weight / weight.sum()
    w, bias = np.zeros(found.shape[1], np.float32), 0.0
    mean_w, mean_b = np.zeros_like(w), 0.0
    for _ in range(STEPS):
        slope_w, slope_b = DECAY * w, 0.0
        for at in range(0, n, BLOCK):
            x = scaled(found[at : at + BLOCK])
            slope = ((1 / (1 + np.exp(-np.clip(x @ w + bias, -50, 50))) - target[at : at + BLOCK]) * weight[at : at + BLOCK]).astype(np.float32)
            slope_w = slope_w + slope @ x
            slope_b += float(slope.sum())
        mean_w, mean_b = 0.9 * mean_w + slope_w, 0.9 * mean_b + slope_b
        w, bias = w - 10 * RATE * mean_w, bias - RATE * mean_b
    return Scorer(w.astype(np.float32), bias)


def voted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, h): the votes on each different text, by its hash."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([batch.column("h"), pa.array(["".join("bngx"[v + 1] for v in votes(x)) for x in texts(batch)], pa.string())], ["h", "pattern"])

        return one

    rows = df.select(filled(text_col)).select("text", F.xxhash64("text").alias("h"))
    return map_batches(rows, make, "h bigint, pattern string").distinct()


def _patterns(found: list) -> np.ndarray:
    return np.array([["bngx".index(c) - 1 for c in r["pattern"]] for r in found], np.int64).reshape(-1, len(HEURISTICS))


def label_model(df: DataFrame, text_col: str = "text") -> LabelModel:
    """From the votes on all documents, each different text once, so that copies do not outvote others."""
    found = voted(df, text_col).groupBy("pattern").agg(F.count("*").alias("n")).collect()  # 4 ** heuristics rows at most
    return estimate(_patterns(found), np.array([r["n"] for r in found], float))


def fit(df: DataFrame, text_col: str = "text", fit_documents: int = FIT_DOCUMENTS) -> tuple[LabelModel, Scorer]:
    each = materialise(voted(df, text_col))
    found = each.groupBy("pattern").agg(F.count("*").alias("texts")).orderBy("pattern").collect()  # 4 ** heuristics rows at most
    model = estimate(_patterns(found), np.array([r["texts"] for r in found], float))
    good = model.posterior(_patterns(found))
    kinds = {bad: [(r["pattern"], r["texts"]) for r, g in zip(found, good, strict=True) if (g < KEEP) == bad and r["pattern"] != "x" * len(HEURISTICS)] for bad in (True, False)}
    texts_of = {bad: sum(n for _, n in rows) for bad, rows in kinds.items()}
    if not (texts_of[True] and texts_of[False]):
        return model, Scorer(np.zeros(DIMENSIONS + EXTRA, np.float32), 3.0)
    half = fit_documents // 2
    share = lambda bad: (1 << 30) * min(1.0, max(half, fit_documents - texts_of[not bad]) / texts_of[bad])
    limit = F.lit(-1).cast("double")
    for bad, rows in kinds.items():
        limit = F.when(F.col("pattern").isin([p for p, _ in rows]), F.lit(float(share(bad)))).otherwise(limit)
    drawn = each.where(F.pmod(F.col("h"), F.lit(1 << 30)) < limit).select(F.col("h").alias("__h"), F.col("pattern").alias("__pattern"))
    # about fit_documents hashes, so they may go to every task; each text is drawn once
    rows = df.select(filled(text_col)).join(F.broadcast(drawn), F.xxhash64("text") == F.col("__h")).groupBy("__h").agg(F.first("text").alias("text"), F.first("__pattern").alias("pattern"))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([batch.column("pattern"), pa.array([compact(features(x)) for x in texts(batch)], pa.binary())], ["pattern", "features"])

        return one

    gathered = map_batches(rows, make, "pattern string, features binary").orderBy("pattern", "features").collect()  # about fit_documents rows of 4 KB
    posterior = {r["pattern"]: float(g) for r, g in zip(found, good, strict=True)}
    target = np.array([posterior[r["pattern"]] for r in gathered])
    bad = target < KEEP
    if bad.all() or not bad.any():  # so few of a kind that none was drawn
        return model, Scorer(np.zeros(DIMENSIONS + EXTRA, np.float32), 3.0)
    of_bad = max(texts_of[True] / (texts_of[True] + texts_of[False]), LEAST_BAD)
    weight = np.where(bad, of_bad / bad.sum(), (1 - of_bad) / (~bad).sum())
    features_of = np.frombuffer(b"".join([r["features"] for r in gathered]), np.uint8).reshape(-1, DIMENSIONS + EXTRA)
    return model, train(features_of, target, weight)


def score(df: DataFrame, model: LabelModel, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, weak_label, score, kept): the votes' posterior, the scorer's probability, the decision."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = texts(batch)
            weak = model.posterior(np.array([votes(x) for x in values], np.int64))
            found = [scorer.score(x) for x in values]
            return pa.record_batch([batch.column("id"), pa.array(weak, pa.float64()), pa.array(found, pa.float64()), pa.array([s >= KEEP for s in found])], ["id", "weak_label", "score", "kept"])

        return one

    rows = df.select(F.col(id_col).alias("id"), filled(text_col))
    return map_batches(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, weak_label double, score double, kept boolean").withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text the scorer keeps."""

    def make():
        return lambda batch: batch.filter(pa.array([scorer.score(x or "") >= KEEP for x in batch.column(text_col).to_pylist()]))

    return map_batches(df, make, df.schema)


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on ``df`` and score it."""
    return score(df, *fit(df, text_col), id_col, text_col)
