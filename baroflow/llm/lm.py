"""Log-probabilities of texts under a smoothed word bigram model, walked as a backoff automaton.

The states are a root and one state per known word (the last word read). A state has an arc
for every word that followed it in training, weighted with the interpolated log-probability,
and a failure arc to the root, weighted with the log of the mass left for other words; the
root's arcs are the unigram model. One walk from left to right over a text adds the weights.

    p(w | h) = (1 - b(h)) * c(h w) / c(h) + b(h) * p(w),   p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

b(h) = D * c(h)^(beta - 1) is absolute discounting with the number of different followers of
h replaced by its expected value c(h)^beta; D and beta come from counts over the whole
training part: D = n1 / (n1 + 2 n2) of the bigrams, and beta such that the expected numbers
of followers add up to the number of different bigrams. Probabilities add up to 1.

The whole model fits nowhere and need not. Texts are cut into blocks by a hash; a block
sends its sorted distinct n-grams with their counts to the n-grams' owners (by leading bits),
an owner adds up and answers in the order asked, and the block builds the part of the
automaton that its texts can reach.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baroflow.llm.common import fold, parts_for, text_bytes
from baroflow.llm.words import chunks, mix, pack_sorted, unpack_sorted, words
from baroflow.plans.staging import stage

START, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x6C62272E07BB0142)
UNIGRAM, BIGRAM = 0, 1
# What owners report besides answers: plain sums, then histogram cells of history counts.
_TOKENS, _TYPES, _ONCE, _TWICE, _CELLS = 0, 1, 2, 3, 10

_ASK = "kind int, bucket int, block long, keys binary, counts binary"
_ANSWER = "block long, kind int, bucket int, totals binary, stat int, n long, mass long"


class Model(NamedTuple):
    tokens: int
    types: int
    discount: float
    growth: float

    @property
    def space(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / self.space

    def back_off(self, history: np.ndarray) -> np.ndarray:
        return np.clip(self.discount * np.maximum(history, 1.0) ** (self.growth - 1), 1e-6, 1.0)


class Block(NamedTuple):
    """Tokens of some texts: each text's words, then the end. ``unigrams`` also holds the start."""

    row: np.ndarray
    token: np.ndarray  # index into unigrams
    history: np.ndarray  # index into unigrams
    pair: np.ndarray  # index into bigrams
    unigrams: np.ndarray
    bigrams: np.ndarray


def read_block(texts: pa.Array) -> Block:
    tokens, rows = [], []
    n_rows = 0
    for chunk in chunks(texts):
        found = words(chunk)
        n = len(chunk.offsets) - 1
        tokens.append(np.insert(found.hashes, found.first[1:], END))
        rows.append(n_rows + np.repeat(np.arange(n), np.diff(found.first) + 1))
        n_rows += n
    token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    history = np.empty_like(token)
    history[1:] = token[:-1]
    history[np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]] = START
    unigrams, at = np.unique(np.append(token, START), return_inverse=True)
    bigrams, pair = np.unique(mix(history * np.uint64(0x9E3779B97F4A7C15) + token), return_inverse=True)
    token_at = at[:-1].astype(np.int32)
    start_at = np.int32(at[-1])
    history_at = np.empty_like(token_at)
    history_at[1:] = token_at[:-1]
    history_at[history == START] = start_at
    return Block(row, token_at, history_at, pair.astype(np.int32), unigrams, bigrams)


def _planes(counts: np.ndarray) -> bytes:
    return np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel().astype(np.int64)


def _asker(bits: int):
    def ask(table: pa.Table) -> pa.Table:
        block = read_block(table.column("text"))
        learn = np.asarray(table.column("learn").to_numpy(), bool)
        used = learn[block.row]
        starts = np.zeros(len(block.unigrams), np.int64)
        starts[np.searchsorted(block.unigrams, START)] = learn.sum()
        counts = [
            np.bincount(block.token[used], minlength=len(block.unigrams)) + starts,
            np.bincount(block.pair[used], minlength=len(block.bigrams)),
        ]
        out: list[list] = [[], [], [], [], []]
        number = table.column("block")[0].as_py()
        for kind, keys in enumerate((block.unigrams, block.bigrams)):
            bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else []
            for a, b in zip(edges[:-1], edges[1:]):
                for column, value in zip(
                    out, (kind, int(bucket[a]), number, pack_sorted(keys[a:b]), _planes(counts[kind][a:b]))
                ):
                    column.append(value)
        return pa.table(
            {
                "kind": pa.array(out[0], pa.int32()), "bucket": pa.array(out[1], pa.int32()), "block": pa.array(out[2], pa.int64()),
                "keys": pa.array(out[3], pa.binary()), "counts": pa.array(out[4], pa.binary()),
            }
        )

    return ask


def _history_cell(count: np.ndarray) -> np.ndarray:
    """Exact up to 63, then eight cells per doubling."""
    return np.where(count < 64, count, 64 + 8 * (np.log2(np.maximum(count, 1)) - 6)).astype(np.int64)


def _own(table: pa.Table) -> pa.Table:
    """Add up the counts of one bucket and answer each block in the order in which it asked."""
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([_from_planes(x) for x in table.column("counts").to_pylist()])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    rows = [
        (b, _planes(total[at[e - len(k) : e]]), -1, 0, 0) for b, k, e in zip(table.column("block").to_pylist(), keys, ends)
    ]
    seen = total > 0
    if kind == UNIGRAM:
        known = seen & (distinct != START)
        report = {_TOKENS: (int(total[known].sum()), 0), _TYPES: (int(known.sum()), 0)}
        past = total[seen & (distinct != END)]
        cell = _history_cell(past)
        n, mass = np.bincount(cell), np.bincount(cell, weights=past)
        report |= {_CELLS + int(c): (int(n[c]), int(mass[c])) for c in np.flatnonzero(n)}
    else:
        report = {_TYPES: (int(seen.sum()), 0), _ONCE: (int((total == 1).sum()), 0), _TWICE: (int((total == 2).sum()), 0)}
    rows += [(-1, b"", stat, n, mass) for stat, (n, mass) in report.items()]
    block, totals, stat, n, mass = zip(*rows)
    return pa.table(
        {
            "block": pa.array(block, pa.int64()), "kind": pa.array([kind] * len(rows), pa.int32()),
            "bucket": pa.array([bucket] * len(rows), pa.int32()), "totals": pa.array(totals, pa.binary()),
            "stat": pa.array(stat, pa.int32()), "n": pa.array(n, pa.int64()), "mass": pa.array(mass, pa.int64()),
        }
    )


def fit(stats: dict[tuple[int, int], tuple[int, int]]) -> Model:
    """Discount and growth from the owners' sums, keyed by kind and statistic."""
    get = lambda kind, stat: stats.get((kind, stat), (0, 0))[0]
    once, twice, pairs = get(BIGRAM, _ONCE), get(BIGRAM, _TWICE), get(BIGRAM, _TYPES)
    cells = [v for (kind, stat), v in sorted(stats.items()) if kind == UNIGRAM and stat >= _CELLS]
    n = np.array([c[0] for c in cells], float)
    mean = np.array([c[1] for c in cells], float) / np.maximum(n, 1)
    low, high = 0.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if (n * mean**middle).sum() < pairs else (low, middle)
    discount = once / (once + 2 * twice) if once else 0.5
    return Model(get(UNIGRAM, _TOKENS), get(UNIGRAM, _TYPES), float(np.clip(discount, 0.05, 0.95)), high)


class Automaton:
    """The part of the backoff automaton that one block's texts can reach."""

    def __init__(self, model: Model, words_seen: np.ndarray, pairs_seen: np.ndarray):
        self.model = model
        self.words_seen, self.pairs_seen = words_seen, pairs_seen
        self.root_arc = np.log10(model.unigram(words_seen))
        self.failure = model.back_off(words_seen.astype(float))

    def walk(self, block: Block) -> np.ndarray:
        """The weight added at each token. The state before it is its history's, or the root."""
        past, count = self.words_seen[block.history], self.pairs_seen[block.pair]
        failure = self.failure[block.history]
        root = self.root_arc[block.token]
        weight = np.where(past > 0, np.log10(failure) + root, root)  # the failure arc, then the root's
        arc = np.flatnonzero(count > 0)
        kept = (1 - failure[arc]) * count[arc] / past[arc]
        weight[arc] = np.log10(kept + failure[arc] * 10 ** root[arc])
        return weight


def _scorer(model: Model):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = read_block(docs.column("text"))
        answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds = answers.column("kind").to_numpy()
        totals = answers.column("totals").to_pylist()
        seen = [
            np.concatenate([np.zeros(0, np.int64), *[_from_planes(t) for t, k in zip(totals, kinds) if k == kind]])
            for kind in (UNIGRAM, BIGRAM)
        ]
        automaton = Automaton(model, *seen)
        n = docs.num_rows
        add = lambda weights: np.bincount(block.row, weights=weights, minlength=n)
        return pa.table(
            {
                "id": docs.column("id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(np.bincount(block.row, minlength=n)),
                "n_known": pa.array(np.bincount(block.row[seen[0][block.token] > 0], minlength=n)),
                "train_tokens": pa.array(np.full(n, model.tokens)),
                "base_score": pa.array(add(automaton.root_arc[block.token])),
                "score": pa.array(add(automaton.walk(block))),
            }
        )

    return score


def lm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out_fold: int = 1,
    block_bytes: int = 6 << 20,
    bucket_bytes: int = 4 << 20,
) -> DataFrame:
    """Score every row with a model learned from the rows outside one of five folds of the id.

    Tokens are the words (runs outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased) and one end; null
    and empty texts have the end only. Returns ``id_col, held_out, n_tokens, n_known,
    train_tokens, base_score`` (unigram) and ``score`` (the bigram model). Rows with a null
    id are scored but not learned from; repeated rows count each time. An empty table gives
    no rows; without training rows every token is unknown. Equal texts have equal scores.

    Blocks and buckets hold about the given bytes of text, so their number grows with the
    input and their size does not.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = text_bytes(rows)
    n_blocks = parts_for(total, block_bytes)
    bits = max(0, parts_for(total, bucket_bytes) - 1).bit_length()
    rows = rows.select(
        "id",
        "text",
        F.coalesce(fold("id") == held_out_fold, F.lit(False)).alias("held_out"),
        F.coalesce(fold("id") != held_out_fold, F.lit(False)).alias("learn"),
        F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).alias("block"),
    )
    answers = (
        rows.groupBy("block").applyInArrow(_asker(bits), _ASK).groupBy("kind", "bucket").applyInArrow(_own, _ANSWER)
    )
    answers = stage(answers, "answers")
    sums = answers.where("block = -1").groupBy("kind", "stat").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))
    model = fit({(r["kind"], r["stat"]): (r["n"], r["mass"]) for r in sums.collect()})
    id_type = docs.schema[id_col].dataType.simpleString()
    out = (
        rows.groupBy("block")
        .cogroup(answers.where("block >= 0").select("block", "kind", "bucket", "totals").groupBy("block"))
        .applyInArrow(
            _scorer(model),
            f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
    return out.withColumnRenamed("id", id_col)
