"""Toxicity by maximum-scoring segments (operator 1).

Learning. From labelled rows only: per word and word beginning (4 to 8 letters, so that
unseen endings of a toxic stem count too), the log-odds between toxic and clean documents under an informative Dirichlet prior (the prior of a word is its
share of all labelled documents, ``prior_docs`` strong, but never less than a floor that does not
depend on the table's size), less ``deviations`` standard
deviations, so that a word with little evidence scores nothing. Those whose lower
bound exceeds ``least`` form the lexicon, whole: it grows with the labelled rows read, which
``max_labelled`` bounds, and not with the table. A word scores the best of its entries, or ``-drift``
if it has none.

Scoring. The linear-time all-maximal-segments scan (Ruzzo and Tompa) over the word
scores of the whole text gives every maximal toxic passage. Scores of passages are
put on the extreme-value scale: ``lambda`` solves ``sum p(s) exp(lambda s) = 1`` over the
words of clean documents, ``K`` is the rate at which lexicon words begin passages there,
and a passage of score S in a text of n words has E-value ``K n exp(-lambda S)``. A
document's evidence is the sum of ``-ln E`` over passages with E below ``max_e``; a
logistic curve fitted on the labelled rows turns it into a probability.

Nulls and empty texts have no passage and get the curve's value at no evidence. Very long
texts are scanned whole, in time linear in their words. Repeated rows come out as often as they
stand; of passages of equal score the first is named. Without labelled rows of both kinds nothing can be learnt: all scores are 0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import fold, kept

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are scored like words.
STEMS = range(4, 9)
#: Word scores that a worker keeps at hand, at most.
KEPT_WORDS = 200_000
#: Labelled rows that the model is fitted on, at most; those with the smallest hash of the id.
MAX_LABELLED = 40_000


@dataclass
class ToxicityModel:
    scores: dict[str, float]
    drift: float
    lam: float
    k: float
    slope: float
    bias: float
    max_e: float = 1.0
    seen: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def score_of(self, word: str) -> float:
        """The best entry for a word or one of its beginnings; 0 if there is none."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= KEPT_WORDS:
                self.seen.clear()
            found = self.seen[word] = max(self.scores.get(f, 0.0) for f in features_of(word))
        return found

    @property
    def fitted(self) -> bool:
        return bool(self.scores)

    def probability(self, evidence):
        if not self.fitted:
            return np.zeros_like(np.asarray(evidence, dtype=float))
        return 1.0 / (1.0 + np.exp(-(self.slope * np.asarray(evidence, dtype=float) + self.bias)))


def features_of(word: str) -> list[str]:
    """A word and its beginnings, the latter marked by a star."""
    return [word, *(f"{word[:k]}*" for k in STEMS if k < len(word))]


def maximal_segments(positions, scores, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring runs (start, end exclusive, score) of a sequence.

    ``positions`` are the places of positive scores in rising order; each other
    place scores ``-drift``. Each run keeps the nearest earlier run of a lower total before, so that a
    search skips what an earlier search has passed: the scan is linear in the positive places.
    """
    runs: list[list] = []  # start, end, total before, total after, nearest earlier run of a lower total before
    total, at = 0.0, 0
    for position, score in zip(positions, scores):
        total -= drift * (position - at)
        left, total, at = total, total + score, position + 1
        start, j = position, len(runs) - 1
        while True:
            while j >= 0 and runs[j][2] >= left:
                j = runs[j][4]
            if j < 0 or runs[j][3] >= total:
                runs.append([start, at, left, total, j])
                break
            start, _, left, _, before = runs[j]
            del runs[j:]
            j = before
    return [(int(s), int(e), after - before) for s, e, before, after, _ in runs]


def find_passages(text: str | None, model: ToxicityModel) -> tuple[list[tuple[int, int, float]], int]:
    """Maximal passages (word positions, score) of a whole text, and its number of words."""
    words = WORD.findall(text.lower()) if text else []
    if not model.scores:
        return [], len(words)
    hits = [(i, s) for i, w in enumerate(words) if (s := model.score_of(w))]
    return maximal_segments([i for i, _ in hits], [s for _, s in hits], model.drift), len(words)


def evidence_of(passages, n_words: int, model: ToxicityModel) -> tuple[float, int]:
    """Summed -ln E of the significant passages, and how many they are."""
    floor = math.log(model.k * max(n_words, 1)) - math.log(model.max_e)
    gains = [g for _, _, s in passages if (g := model.lam * s - floor) > 0]
    return sum(gains), len(gains)


def _count_words(batches):
    kept("toxicity")
    for pdf in batches:
        toxic: dict[str, int] = {}
        clean: dict[str, int] = {}
        n_words = 0
        for text, label in zip(pdf["text"], pdf["label"]):
            words = WORD.findall(text.lower()) if text else []
            if not label:
                n_words += len(words)
            counts = toxic if label else clean
            for feature in {f for w in set(words) for f in features_of(w)}:
                counts[feature] = counts.get(feature, 0) + 1
        rows = [(w, toxic.get(w, 0), clean.get(w, 0)) for w in toxic.keys() | clean.keys()]
        rows.append((None, 0, n_words))
        yield pd.DataFrame(rows, columns=["word", "toxic", "clean"])


def lower_bound(toxic: Column, clean: Column, n_toxic: int, n_clean: int, prior_docs: float = 50.0,
                deviations: float = 2.0) -> Column:
    """Lower bound of a word's log-odds, from the toxic and clean documents that hold it; null without toxic ones.

    The bound rises as the clean side b falls, as long as ``b * b / a + b >= deviations ** 2 / 4``; b
    stays at that at least, so that a word does not lose by having no clean document.
    """
    prior = (toxic + clean) / (n_toxic + n_clean) * prior_docs
    a = toxic + F.greatest(prior, F.lit(0.5))
    b = F.greatest(clean + prior, F.lit(max(0.5, deviations ** 2 / 4)))
    odds = F.log(a / F.greatest(n_toxic + prior_docs + 1 - a, F.lit(1.0))) - F.log(
        b / F.greatest(n_clean + prior_docs + 1 - b, F.lit(1.0)))
    return F.when(toxic > 0, odds - deviations * F.sqrt(1 / a + 1 / b))


def solve_lambda(scores: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1 for a drifting-down score."""
    rest = 1.0 - shares.sum()
    value = lambda lam: float((shares * np.exp(lam * scores)).sum() + rest * math.exp(-lam * drift)) - 1.0
    low, high = 1e-6, 1e-6
    while value(high) <= 0 and high < 50:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) <= 0 else (low, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_labelled: int = MAX_LABELLED, prior_docs: float = 50.0,
        deviations: float = 2.0, least: float = 1.0, drift: float = 0.25, max_e: float = 1.0) -> ToxicityModel:
    """Learn a model from the labelled rows of ``docs``.

    ``labels`` (id, 0/1 label) must already be restricted to the rows to learn from;
    null labels are left out, and an id that is labelled twice counts with its largest label.
    """
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_key")).agg(F.max(label_col).cast("int").alias("label")))
    # Bounded by max_labelled whatever the size of the table, hence fit for a broadcast.
    known = known.orderBy(F.xxhash64("_key"), "_key").limit(max_labelled)
    train = (docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("text"))
             .join(F.broadcast(known), "_key").select("text", "label"))
    none = ToxicityModel({}, drift, 1.0, 1.0, 1.0, 0.0, max_e)
    totals = {bool(r["label"]): r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return none
    n_toxic, n_clean = totals[True], totals[False]

    counts = (train.mapInPandas(_count_words, "word string, toxic long, clean long")
              .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    bound = lower_bound(F.col("toxic"), F.col("clean"), n_toxic, n_clean, prior_docs, deviations)
    lexicon = counts.select("word", "clean", F.when(F.col("word").isNotNull(), bound).alias("score"))
    best = (lexicon.filter(F.col("word").isNull() | (F.col("score") > least))
            .orderBy(F.col("score").desc_nulls_first(), "word").collect())
    words = [r for r in best if r["word"] is not None]
    if not words:
        return none
    clean_words = max(sum(r["clean"] for r in best if r["word"] is None), 1)
    scores = np.array([r["score"] for r in words])
    shares = np.array([(r["clean"] + 0.5) / clean_words for r in words])
    shares *= min(1.0, 0.5 / shares.sum())
    lam = solve_lambda(scores, shares, drift)
    k = max(float(shares.sum()), 1e-12)
    model = ToxicityModel({r["word"]: float(r["score"]) for r in words}, drift, lam, k, 1.0, 0.0, max_e)

    def levels(batches):
        kept("toxicity")
        for pdf in batches:
            found = [round(evidence_of(*find_passages(t, model), model)[0], 1) for t in pdf["text"]]
            part = pd.DataFrame({"level": found, "label": pdf["label"], "n": 1})
            yield part.groupby(["level", "label"], as_index=False)["n"].sum()

    tally = (train.mapInPandas(levels, "level double, label int, n long")
             .groupBy(F.least(F.col("level"), F.lit(200.0)).alias("level"), "label")
             .agg(F.sum("n").alias("n")).collect())
    x = np.array([r["level"] for r in tally])
    y = np.array([r["label"] for r in tally], dtype=float)
    n = np.array([r["n"] for r in tally], dtype=float)
    model.slope, model.bias = fit_logistic(x, y, n)
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and bias by Newton's method with a weak ridge."""
    scale = max(float(x.max(initial=0.0)), 1.0)
    features = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        gradient = features.T @ (weight * (y - p)) - 1e-3 * beta
        curve = (features * (weight * p * (1 - p))[:, None]).T @ features + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(curve, gradient), -5, 5)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0] / scale), 0.0), float(beta[1])


SCHEMA = ("held_out boolean, score double, predicted int, evidence double, n_passages int, n_words long, "
          "passage_start long, passage_end long, passage_score double")


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """One row per document: probability, decision and the strongest passage (word positions)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches):
        kept("toxicity")
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                passages, n = find_passages(text, model)
                evidence, found = evidence_of(passages, n, model)
                rows.append((evidence, found, n, *max(passages, key=lambda r: r[2], default=(None, None, None))))
            evidence, found, n, start, end, best = zip(*rows) if rows else ((),) * 6
            chance = model.probability(evidence)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(chance, pa.float64()),
                 pa.array(chance >= threshold).cast(pa.int32()), pa.array(evidence, pa.float64()),
                 pa.array(found, pa.int32()), pa.array(n, pa.int64()), pa.array(start, pa.int64()),
                 pa.array(end, pa.int64()), pa.array(best, pa.float64())],
                names=["doc_id", "held_out", "score", "predicted", "evidence", "n_passages", "n_words",
                       "passage_start", "passage_end", "passage_score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       (fold(F.col(id_col)) == 0).alias("held_out"))
    return slim.mapInArrow(scored, f"doc_id {kind}, {SCHEMA}")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose probability stays below ``threshold``."""
    def clean(batches):
        kept("toxicity")
        for batch in batches:
            evidence = [evidence_of(*find_passages(t, model), model)[0] for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(model.probability(evidence) < threshold, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
