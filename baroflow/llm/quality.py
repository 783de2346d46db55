"""Quality classifier from trusted positives and unlabelled text: non-negative PU learning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baroflow.llm.common import few, fold
from baroflow.llm.words import chunks, words
from baroflow.plans.staging import stage

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[]_{|}"
#: Kinds of bytes: space, line break, lower, upper, digit, non-ASCII, each common mark, the rest.
_KINDS = 7 + len(_PUNCTUATION)
_KIND = np.full(256, _KINDS - 1, np.uint8)
_KIND[[0x20, 0x09]], _KIND[[0x0A, 0x0B, 0x0C, 0x0D]] = 0, 1
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1], _KIND[128:] = 2, 3, 4, 5
for _i, _b in enumerate(_PUNCTUATION):
    _KIND[_b] = 6 + _i
N_FEATURES = _KINDS * _KINDS + 5
#: Rows of dense features in memory at a time, some 2.5 MB an array, however short the texts are.
SLICE_ROWS = 256


def features(texts: pa.Array):
    """Per chunk: its first row, and a row of features for each text.

    Square roots of the shares of neighbouring byte kinds (which show case, marks, digits and
    layout whatever the words are), the shares of words equal to the one before and of
    different words, mean word length, logs of the numbers of words and bytes. All are 0
    for an empty text.
    """
    for chunk in chunks(texts, rows=SLICE_ROWS):
        n = len(chunk.offsets) - 1
        size = np.diff(chunk.offsets)
        row = np.repeat(np.arange(n), size)
        kind = _KIND[chunk.data].astype(np.int64)
        out = np.zeros((n, N_FEATURES))
        pair = np.flatnonzero(row[1:] == row[:-1])
        cell = row[pair] * (_KINDS * _KINDS) + kind[pair] * _KINDS + kind[pair + 1]
        counts = np.bincount(cell, minlength=n * _KINDS * _KINDS).reshape(n, -1)
        out[:, :-5] = np.sqrt(counts / np.maximum(size - 1, 1)[:, None])
        found = words(chunk)
        number = np.diff(found.first)
        of = np.repeat(np.arange(n), number)
        again = (of[1:] == of[:-1]) & (found.hashes[1:] == found.hashes[:-1])
        order = np.lexsort((found.hashes, of))
        h, o = found.hashes[order], of[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])[: len(h)]
        total = np.maximum(number, 1)
        out[:, -5] = np.bincount(of[1:][again], minlength=n) / total
        out[:, -4] = np.bincount(o[new], minlength=n) / total
        out[:, -3] = np.bincount(of, weights=found.end - found.begin, minlength=n) / total / 10
        out[:, -2] = np.log1p(number) / 10
        out[:, -1] = np.log1p(size) / 10
        yield chunk.start, out


def _featuriser(batches):
    """Features as the numbers and values of those that are not 0, some 200 a text."""
    for batch in batches:
        for start, x in features(batch.column(1)):
            row, cell = np.nonzero(x)
            ends = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(v))
                for v in (cell.astype(np.int16), x[row, cell].astype(np.float32))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, len(x)), *lists], names=["trusted", "cells", "values"]
            )


def _dense(fitted: pa.Table) -> tuple[np.ndarray, int]:
    """One single-precision row of features for each text, trusted ones first, and their number."""
    x = np.zeros((fitted.num_rows, N_FEATURES), np.float32)
    trusted = int(pc.sum(fitted.column("trusted").cast("int64")).as_py() or 0)
    at = {True: 0, False: trusted}
    for batch in fitted.to_batches():
        for is_trusted, cells, values in zip(*batch.columns):
            x[at[is_trusted.as_py()], cells.values.to_numpy()] = values.values.to_numpy()
            at[is_trusted.as_py()] += 1
    return x, trusted


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(
    x: np.ndarray, n_positive: int, prior: float, rounds: int = 1000, rate: float = 0.05, penalty: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative unbiased risk with the logistic loss.

    ``x`` holds ``n_positive`` positive rows, then the unlabelled ones; it is standardised in
    place, so that the driver holds one single-precision copy.

    risk = prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]). While the second part
    is negative, which no true risk is, its gradient is followed upwards.
    """
    positive, unlabelled = x[:n_positive], x[n_positive:]
    centre = unlabelled.mean(0, dtype=np.float64)
    x -= centre.astype(np.float32)
    square = np.array([np.dot(column, column) for column in unlabelled.T], np.float64)
    spread = np.sqrt(square / len(unlabelled)) + 0.01
    x /= spread.astype(np.float32)
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        single = w.astype(np.float32)
        f_p, f_u = (positive @ single).astype(np.float64) + b, (unlabelled @ single).astype(np.float64) + b
        s_p, s_u = _sigmoid(f_p), _sigmoid(f_u)
        rest = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        g_p = prior * (s_p - 1) / len(s_p)
        sign = 1.0 if rest >= 0 else -1.0
        if rest < 0:
            g_p = np.zeros(len(s_p))
        g_p = g_p - sign * prior * s_p / len(s_p)
        g_u = sign * s_u / len(s_u)
        by_row = np.concatenate([g_p, g_u])
        g = np.append(by_row.astype(np.float32) @ x + penalty * w, by_row.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    w = w / spread
    return w, float(b - centre @ w)


def _sample(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hashes of their id: the same rows at every run."""
    return df.orderBy(F.xxhash64(F.lit(7), column), column).limit(n)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    held_out_fold: int = 0,
    threshold: float = 0.3,
    max_positive: int = 4000,
    max_unlabelled: int = 8000,
) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row.

    Positives are rows labelled 1 and the class prior is the share of 1 among the labelled
    rows, both outside the held-out fold of the id; unlabelled text is every row without a
    label outside that fold (if there is none, the labelled rows outside the fold with their
    labels ignored). Nothing but the text enters a score. At most ``max_positive`` and
    ``max_unlabelled`` rows, chosen by a hash of the id, are fitted on the driver (some 80 MB);
    scoring covers every whole text. Null and empty texts have all features 0 and score by
    the bias. Null labels and null ids are not learned from; of labels that repeat an id the
    largest counts. Without any positive every score is the prior (0.5 if unknown).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    )
    learn = F.coalesce(fold("id") != held_out_fold, F.lit(False))
    train = known.where(learn)
    share = train.agg(F.avg("y").alias("p")).first()["p"]
    prior = float(np.clip(0.5 if share is None else share, 0.01, 0.99))
    ids = rows.where(learn).select("id")
    trusted = _sample(ids.join(train.where("y = 1"), "id", "left_semi"), "id", max_positive)
    plain = ids.join(known.select("id"), "id", "left_anti")
    if plain.isEmpty():
        plain = ids
    chosen = trusted.withColumn("trusted", F.lit(True)).union(
        _sample(plain, "id", max_unlabelled).withColumn("trusted", F.lit(False))
    )
    fitted = (
        rows.join(few(chosen, max_positive + max_unlabelled), "id")
        .select("trusted", "text")
        .mapInArrow(_featuriser, "trusted boolean, cells array<short>, values array<float>")
        .toArrow()
    )
    x, n_trusted = _dense(fitted)
    if 0 < n_trusted < len(x):
        weights, bias = fit_nnpu(x, n_trusted, prior)
    else:
        weights, bias = np.zeros(N_FEATURES), float(np.log(prior / (1 - prior)))
    del x, fitted

    def score(batches):
        for batch in batches:
            for start, f in features(batch.column(1)):
                s = _sigmoid(f @ weights + bias)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(f)), pa.array(s)], names=["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(score, f"id {id_type}, score double").select(
        F.col("id").alias(id_col),
        F.coalesce(fold("id") == held_out_fold, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted to be of low quality; all columns stay, null ids too."""
    bad = quality_scores(docs, labels, id_col, text_col).where("predicted = 0").select(F.col(id_col).alias("_bad_id"))
    bad = few(stage(bad.distinct(), "rejected"), 1_000_000)
    return docs.join(bad, docs[id_col] == bad["_bad_id"], "left_anti")
