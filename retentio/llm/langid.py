"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 7).

Texts are lower-cased, every run of other characters than letters becomes one kind of
mark, and each n-gram of 1 to ``max_order`` code points that holds a letter is hashed into
``2 ** bits`` buckets. Learning counts buckets per language over all learning rows (partial
sums in the tasks, then one small aggregation); the log-probability matrix has one float
per bucket and language, a size that does not grow with the rows, and goes to every task.
Scoring gathers matrix rows for a whole Arrow batch in numpy and sums them by document.

Null texts and texts without a letter are ``und`` with score 0; so is every text if no
row has both a language and a letter. Ties go to the language first in sorted order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import code_points, fold, segment_sums

UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # language x bucket
    log_prior: np.ndarray
    bits: int
    max_order: int


def letters_of(points: np.ndarray) -> np.ndarray:
    """True where a code point is a letter, by Python's ``str.isalpha``."""
    kinds, where = (np.unique(points, return_inverse=True) if points.size < 1 << 12
                    else (np.flatnonzero(np.bincount(points)).astype(np.uint32), None))
    alpha = np.array([chr(c).isalpha() for c in kinds], dtype=bool)
    if where is not None:
        return alpha[where] if kinds.size else np.zeros(0, bool)
    table = np.zeros(int(kinds[-1]) + 1, bool)
    table[kinds] = alpha
    return table[points]


def hashed_ngrams(column: pa.Array, bits: int, max_order: int):
    """Per order, the bucket at each place, and a 0/1 weight (0 where no n-gram begins)."""
    points, offsets = code_points(pc.utf8_lower(column.cast(pa.string())))
    n = len(points)
    letter = letters_of(points)
    code = np.where(letter, points, 0).astype(np.uint64)
    # Places from here to the end of the own document.
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    rolling = np.zeros(n, np.uint64)
    any_letter = np.zeros(n, bool)
    for order in range(1, max_order + 1):
        size = n - order + 1
        if size <= 0:
            break
        rolling = rolling[:size] * np.uint64(0x9E3779B97F4A7C15) + code[order - 1:] + np.uint64(order)
        any_letter = any_letter[:size] | letter[order - 1:]
        valid = any_letter & (left[:size] >= order)
        mixed = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield (mixed >> np.uint64(64 - bits)).astype(np.int64), valid, offsets


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        bits: int = 16, max_order: int = 3, smoothing: float = 0.5) -> LanguageModel | None:
    """Count n-grams over all rows of ``docs`` that have a language; None if there are none."""
    def counted(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            text = batch.column("text")
            for lang in sorted(set(langs)):
                own = text.filter(pa.array([x == lang for x in langs]))
                total = np.zeros(1 << bits, np.int64)
                for bucket, valid, _ in hashed_ngrams(own, bits, max_order):
                    total += np.bincount(bucket[valid], minlength=1 << bits)
                used = np.flatnonzero(total)
                for key, value in ((used, total[used]), (np.array([-1]), np.array([len(own)]))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(key), pa.string()), pa.array(key, pa.int32()),
                         pa.array(value, pa.int64())], names=["lang", "bucket", "n"])

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = merge_in_task(known.mapInArrow(counted, "lang string, bucket int, n long"))
    counts = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    gram = counts[counts["bucket"] >= 0]
    languages = sorted(gram["lang"].unique())
    if not languages:
        return None
    row = {lang: i for i, lang in enumerate(languages)}
    table = np.full((len(languages), 1 << bits), smoothing)
    np.add.at(table, (gram["lang"].map(row).to_numpy(), gram["bucket"].to_numpy()), gram["n"].to_numpy())
    rows = counts[(counts["bucket"] < 0) & counts["lang"].isin(row)].set_index("lang")["n"].reindex(languages)
    return LanguageModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32),
                         np.log(rows.to_numpy() / rows.sum()), bits, max_order)


def merge_in_task(counts: DataFrame) -> DataFrame:
    """Sum a task's partial counts before they are shuffled."""
    def merged(parts):
        kept: pd.DataFrame | None = None
        for part in parts:
            kept = part if kept is None else pd.concat([kept, part])
            if len(kept) > 1_000_000:
                kept = kept.groupby(["lang", "bucket"], as_index=False)["n"].sum()
        if kept is not None:
            yield kept.groupby(["lang", "bucket"], as_index=False)["n"].sum()

    return counts.mapInPandas(merged, counts.schema)


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per document: the likeliest language and its posterior probability."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches):
        model = sent.value
        for batch in batches:
            text = batch.column("text")
            size = len(text)
            known = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names = np.array([UNKNOWN] * size, dtype=object)
            score = np.zeros(size)
            if model is not None and size:
                sums = np.tile(model.log_prior, (size, 1))
                for bucket, valid, offsets in hashed_ngrams(text, model.bits, model.max_order):
                    short = np.minimum(offsets, len(bucket))
                    for i, row in enumerate(model.log_prob):
                        sums[:, i] += segment_sums(np.where(valid, row[bucket], 0.0), short)
                best = sums.argmax(axis=1)
                share = np.exp(sums - sums.max(axis=1, keepdims=True))
                score = np.where(known, 1.0 / share.sum(axis=1), 0.0)
                names = np.where(known, np.array(model.languages, dtype=object)[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names.tolist(), pa.string()),
                 pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       (fold(F.col(id_col)) == 0).alias("held_out"))
    return slim.mapInArrow(predicted, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
