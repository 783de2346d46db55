"""Toxic passages as maximal scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baroflow.llm.common import few, fold
from baroflow.llm.words import LETTER, LOWER, Chunk, chunks, span_hashes, words
from baroflow.plans.staging import stage

PREFIXES = (4, 5, 6)
PRIOR = 0.1  # pseudo-documents of a key's Dirichlet prior, for each document that holds it
DRIFT = -0.5  # added to every token's log-odds, so that texts without evidence drift downwards
LEAST_DOCS = 8  # documents that vouch for a key's own log-odds


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of each word, and its keys: the word and its first bytes, one column each.

    Words are runs of letters, A-Z lower-cased. Prefixes let a word that was never seen count
    by its stem.
    """
    found = words(chunk, LETTER)
    row = np.repeat(np.arange(len(chunk.offsets) - 1), np.diff(found.first))
    spans = [(found.begin, np.minimum(found.end, found.begin + k)) for k in PREFIXES]
    parts = span_hashes(chunk, LOWER, *spans) if len(row) else [found.hashes] * len(PREFIXES)
    salted = [h ^ np.uint64(0xA0761D6478BD642F * (i + 1) % 2**64) for i, h in enumerate(parts)]
    return row, found.begin, found.end, np.stack([found.hashes, *salted], 1)


def _counter(batches):
    """Documents of each class that hold a key; added up within a task while it fits."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        keys = np.concatenate([h[0] for h in held])
        toxic = np.concatenate([h[1] for h in held])
        key, at = np.unique(keys, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key.view(np.int64)),
                pa.array(np.bincount(at, weights=toxic).astype(np.int64)),
                pa.array(np.bincount(at, weights=~toxic).astype(np.int64)),
            ],
            names=["key", "toxic", "clean"],
        )

    for batch in batches:
        label = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)) == 1
        for chunk in chunks(batch.column(1)):
            row, _, _, keys = tokens(chunk)
            rows = np.repeat(row, keys.shape[1])
            keys = keys.ravel()
            order = np.lexsort((keys, rows))
            rows, keys = rows[order], keys[order]
            new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])])[: len(keys)]
            held.append((keys[new], label[chunk.start + rows[new]]))
            size += int(new.sum())
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class Model(NamedTuple):
    keys: np.ndarray  # sorted; all keys that enough documents hold
    odds: np.ndarray  # shrunken log-odds, 0 where the counts vouch for neither class
    decay: float  # lambda of the extreme-value law
    scale: float  # K of the extreme-value law
    slope: float
    offset: float


def token_scores(model: Model, keys: np.ndarray) -> np.ndarray:
    """Log-odds of each word, of either sign, plus the drift.

    A word that enough documents hold has its own; a rare or unseen one that of its longest
    prefix which enough documents hold, or none.
    """
    score = np.full(len(keys), DRIFT)
    left = np.arange(len(keys) if len(model.keys) else 0)
    for column in (0, *range(keys.shape[1] - 1, 0, -1)):  # the word, then its prefixes from long to short
        wanted = keys[left, column]
        at = np.minimum(np.searchsorted(model.keys, wanted), len(model.keys) - 1)
        known = model.keys[at] == wanted
        score[left[known]] += model.odds[at[known]]
        left = left[~known]
    return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last + 1, score)``, left to right, in linear time.

    Each positive stretch starts as a candidate. A candidate is joined with the nearest
    earlier one whose left sum is lower, as long as that one's right sum is lower too.
    """
    out: list = []  # candidates: first, last + 1, sum before, sum after, nearest lower
    positive = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for k in positive:
        first, last, left, right = int(k), int(k) + 1, float(sums[k]), float(sums[k + 1])
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                out.append((first, last, left, right, j))
                break
            first, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, y - x) for a, b, x, y, _ in out]


def passages(model: Model, texts: pa.Array, significance: float = 0.05):
    """Per chunk: first row, number of rows, words per row, best excess per row, and the passages.

    A segment's excess is decay * score - ln(scale * words); by the extreme-value law a clean
    text of that length has a segment beyond it with probability 1 - exp(-exp(-excess)).
    Passages are ``(row, begin, end, score, excess)`` for all segments significant by that.
    """
    least = -np.log(-np.log1p(-significance))
    for chunk in chunks(texts):
        n = len(chunk.offsets) - 1
        row, begin, end, keys = tokens(chunk)
        score = token_scores(model, keys)
        first = np.searchsorted(row, np.arange(n + 1))
        number = np.diff(first)
        best = np.full(n, -np.inf)
        found = []
        for r in np.unique(row[score > 0]):
            a, b = first[r], first[r + 1]
            for i, j, s in maximal_segments(score[a:b]):
                excess = model.decay * s - np.log(model.scale * number[r])
                best[r] = max(best[r], excess)
                if excess >= least:
                    found.append((chunk.start + int(r), int(begin[a + i] - chunk.offsets[r]), int(end[a + j - 1] - chunk.offsets[r]), float(s), float(excess)))
        yield chunk.start, n, number, best, found


def _decay(score: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E[exp(x * score)] = 1 over clean tokens (the drift is negative).

    Given are the keys with a positive score; all other tokens count as the drift, which is
    their highest score.
    """
    rest = max(1e-9, 1 - share.sum())
    value = lambda x: (share * np.exp(x * score)).sum() + rest * np.exp(x * DRIFT) - 1
    if not len(score):
        return 1.0
    high = 1e-3
    while value(high) < 0 and high < 50:
        high *= 2
    low = high / 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def fit_platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small penalty on the slope."""
    slope, offset = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * x).sum() + 1e-2 * slope, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, offset = slope - step[0], offset - step[1]
    return float(max(slope, 1e-3)), float(offset)


_FLOOR, _CEILING = -10.0, 30.0  # the floor also stands for a text without any positive token


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str, held_out_fold: int, least_z: float, max_labelled: int, max_fit: int
) -> Model:
    known = (
        labels.where(F.col("id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy("id").agg(F.max(label_col).cast("int").alias("y"))
        .where(F.coalesce(fold("id") != held_out_fold, F.lit(False)))
    )
    # A share of the labelled ids by their hash, so that ids, keys and what is broadcast stay bounded.
    known = stage(known, "known")
    part = min(1.0, max_labelled / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    train = stage(docs.join(few(known, 2 * max_labelled), "id").select("y", "text", "id").dropDuplicates(["y", "text"]), "labelled")
    size = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, 1.0, float(np.log((n_toxic + 0.5) / (n_clean + 0.5))))
    if not n_toxic or not n_clean:
        return none
    # Dirichlet prior: a pseudo-count for each key in proportion to its share of all documents.
    counts = train.select("y", "text").mapInArrow(_counter, "key long, toxic long, clean long").groupBy("key").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    every, share = F.col("toxic") + F.col("clean"), n_toxic / (n_toxic + n_clean)
    a1, a0 = every * share * PRIOR, every * (1 - share) * PRIOR
    odds = F.log((F.col("toxic") + a1) / (n_toxic + 1 + a1 - F.col("toxic"))) - F.log(
        (F.col("clean") + a0) / (n_clean + 1 + a0 - F.col("clean"))
    )
    error = F.sqrt(1 / (F.col("toxic") + a1) + 1 / (F.col("clean") + a0))
    shrunk = F.signum("odds") * F.greatest(F.abs("odds") - 2 * F.col("error"), F.lit(0.0))  # what the counts vouch for
    table = (
        counts.where(every >= LEAST_DOCS)
        .withColumns({"odds": odds, "error": error})
        .select(
            "key",
            F.when(F.abs("odds") >= F.lit(least_z) * F.col("error"), shrunk).otherwise(0.0).alias("odds"),
            (F.col("clean") / n_clean).alias("share"),
        )
        .toArrow()
    )
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, value, share = keys[order], table.column("odds").to_numpy()[order], table.column("share").to_numpy()[order]
    if not (value > 0).any():
        return none
    # A document's share is an upper bound for a token's; a hundred words a document at least.
    positive = value + DRIFT > 0
    model = none._replace(keys=keys, odds=value, decay=_decay(value[positive] + DRIFT, share[positive] / 100))
    best = _best_scores(train, model, max_fit)
    x, y = best[0], best[1]
    clean = x[y == 0]
    # Of clean texts, 5 % lie beyond the 95 % point of the extreme-value law; most others have
    # no positive token, so the law is placed by that point.
    place = float(np.quantile(clean, 0.95)) + np.log(-np.log(0.95)) if len(clean) else 0.0
    model = model._replace(scale=float(np.exp(place)))
    x = np.clip(x - place, _FLOOR, _CEILING)
    slope, offset = fit_platt(x, y)
    return model._replace(slope=slope, offset=offset)


def _best_scores(train: DataFrame, model: Model, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Excess (with scale 1) and label of at most ``n`` labelled documents."""

    def run(batches):
        for batch in batches:
            for start, size, _, best, _ in passages(model, batch.column(1)):
                part = batch.slice(start, size)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.maximum(best, _FLOOR)), part.column(2)], names=["y", "x", "h"]
                )

    got = train.select("y", "text", F.xxhash64(F.lit(3), "id").alias("h")).mapInArrow(run, "y int, x double, h long")
    table = got.orderBy("h").limit(n).toArrow()
    return table.column("x").to_numpy(), table.column("y").to_numpy()


def toxic_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held_out_fold: int = 0,
    threshold: float = 0.5,
    least_z: float = 3.5,
    max_labelled: int = 500_000,
    max_fit: int = 50_000,
) -> DataFrame:
    """``id_col, held_out, score, predicted, passages`` for every row.

    Counts of words and word prefixes cover the labelled rows outside the held-out fold, at most
    about ``max_labelled`` of them (chosen by a hash of the id). A key held by ``LEAST_DOCS`` of them
    has log-odds of either sign, less two errors, where they are ``least_z`` errors from 0. Each row's
    ``passages`` lists every significant maximal segment with ``begin`` and ``end`` (UTF-8 bytes,
    end exclusive), ``score`` and ``excess``; ``score`` is a logistic curve in the best excess,
    fitted on at most ``max_fit`` labelled rows. Null and empty texts have no passage and the
    lowest score. Null labels and ids are not learned from; of labels that repeat an id the
    largest counts. With one class only, every text scores that class's share.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = labels.select(F.col(id_col).alias("id"), label_col)
    model = fit(rows, named, label_col, held_out_fold, least_z, max_labelled, max_fit)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = "array<struct<begin: long, end: long, score: double, excess: double>>"
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("excess", pa.float64())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            for start, n, _, best, segments in passages(model, batch.column(1)):
                x = np.clip(best, _FLOOR, _CEILING)
                score = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
                lists: list[list[dict]] = [[] for _ in range(n)]
                for r, begin, end, s, excess in segments:
                    lists[r - start].append({"begin": begin, "end": end, "score": s, "excess": excess})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), pa.array(score), pa.array(lists, kind)], names=["id", "score", "passages"]
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, score double, passages {found}").select(
        F.col("id").alias(id_col),
        F.coalesce(fold("id") == held_out_fold, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "passages",
    )
