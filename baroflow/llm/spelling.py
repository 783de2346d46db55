"""Spelling variants: words one edit apart, found among the sorted rotations of all words.

A word ``w`` with a terminator has the rotations ``b$a`` for every split ``w = ab``. Leaving out
the character ``x`` of ``w = axb`` gives ``b$a`` again, the prefix of a rotation that ends in
``x``. Words that share such a prefix differ in that one character; a word whose whole rotation
is the prefix lacks it. A group therefore has one word for each letter at most, and one more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baroflow.plans.staging import stage

#: Fixed value of the rule: letters of a word.
LETTERS = r"[A-Za-zÀ-ÿ]"
END = "$"  # not a letter, below every letter
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rotations of longer words are known by hashes of their two parts, as they would take a
#: space of the square of the length.
LITERAL = 64

_ROTATION = "key string, x string, n long, single boolean, id long"
_FOUND = "key string, x string, id long, near long, best_n long, best_x string, best_id long"
_NOTHING = pa.RecordBatch.from_arrays(
    [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())],
    names=["key", "x", "id", "near", "best_n", "best_x", "best_id"],
)


def ascii_lower(word: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, typos: int = 31
) -> DataFrame:
    """``word, n`` of the words of at least ``least_length`` letters and ``least_count`` occurrences.

    One run of letters in ``typos``, chosen by the id and the run, first loses one letter
    (0: none does). A null text has no words; a null id counts as an empty one.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text_col, F.lit(f"{LETTERS}{{{max(1, least_length)},}}"), 0)).alias("run"),
    ).select("id", ascii_lower(F.col("run")).alias("run"))
    word = F.col("run")
    if typos:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.char_length("run")).cast("int")
        cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length("run")))
        word = F.when(h % typos == 0, cut).otherwise(word)
    return (
        runs.select(word.alias("word"))
        .where(F.char_length("word") >= least_length)
        .groupBy("word").agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_count)
    )


def _literal(words: DataFrame) -> DataFrame:
    """Keys of the words whose rotations are written out: with a letter left out, and whole."""
    w, size, i = F.col("word"), F.char_length("word"), F.col("i")
    placed = words.where(size <= LITERAL + 1).select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    x = F.substring(w, i + 1, F.lit(1))
    before = F.substring(w, F.lit(1), i)
    wild = F.struct(
        F.concat(F.substring(w, i + 2, size), F.lit(END), before).alias("key"), x.alias("x"), (x != F.right(before, F.lit(1))).alias("single")
    )
    whole = F.struct(
        F.concat(F.substring(w, i + 1, size), F.lit(END), before).alias("key"), F.lit("").alias("x"), F.lit(False).alias("single")
    )
    kinds = F.filter(F.array(F.when(i < size, wild), F.when(size <= LITERAL, whole)), lambda k: k.isNotNull())
    return placed.select("n", F.explode(kinds).alias("k")).select("k.key", "k.x", "n", "k.single", F.lit(0).cast("long").alias("id"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same keys of longer words, from running sums over their code points."""
    base = 0x9E3779B97F4A7C13
    for batch in batches:
        for word, n, ref in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "id"))):
            points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
            size = len(points)
            up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]), dtype=np.uint64)
            inverse = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            down = np.cumprod(np.concatenate([np.ones(1, np.uint64), inverse]), dtype=np.uint64)
            value = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[:-1], dtype=np.uint64)])
            single = np.ones(size, bool)
            single[1:] = points[1:] != points[:-1]
            for wild in (True, False):
                if size < LITERAL + 1 + wild:
                    continue
                cut = np.arange(size + (not wild))
                after = cut + wild
                left, right = sums[cut], (sums[size] - sums[after]) * down[after]
                for part in range(0, len(cut), 65536):
                    some = slice(part, part + 65536)
                    keys = [f"#{i}:{size - j}:{a:x}:{b:x}" for i, j, a, b in zip(*(v[some].tolist() for v in (cut, after, left, right)))]
                    m = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys, pa.string()),
                            pa.array([chr(c) for c in points[some]] if wild else [""] * m, pa.string()),
                            pa.array(np.full(m, n), pa.int64()),
                            pa.array(single[some] if wild else np.zeros(m, bool)),
                            pa.array(np.full(m, ref), pa.int64()),
                        ],
                        names=["key", "x", "n", "single", "id"],
                    )


def rotations(words: DataFrame) -> DataFrame:
    """All rotations of every word, with each letter left out and whole, as keys of equal words."""
    long_words = words.where(F.char_length("word") > LITERAL).select("word", "n", F.xxhash64("word").alias("id"))
    return _literal(words).unionByName(long_words.mapInArrow(_hashed, _ROTATION))


def _group_neighbours(table: pa.Table) -> pa.RecordBatch:
    """Each row's neighbours in its group; groups are whole, sorted by key, the most frequent first.

    Rows with a letter left out differ in it from each other; where ``single`` is set they
    have the whole row as a neighbour too, so that a run of equal letters counts once.
    """
    table = table.combine_chunks()
    key = table.column("key").chunk(0)
    group = np.zeros(len(key), np.int64)
    group[1:] = np.cumsum(np.asarray(pc.not_equal(key[1:], key[:-1])))
    groups = int(group[-1]) + 1
    count = table.column("n").to_numpy()
    wild = np.asarray(pc.not_equal(table.column("x").chunk(0), ""))
    single = table.column("single").to_numpy() & wild

    def ahead(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some rows: how many each group has, the first of them, and the second."""
        many = np.bincount(group[rows], minlength=groups)
        at, padded = np.cumsum(many) - many, np.append(rows, [0, 0])
        return many, padded[at], padded[at + 1]

    wilds, best_wild, next_wild = ahead(np.flatnonzero(wild))
    singles, best_single, _ = ahead(np.flatnonzero(single))
    wholes, whole, _ = ahead(np.flatnonzero(~wild))
    parts = []
    at = np.flatnonzero(wild & (wilds[group] > 1))
    to = np.where(best_wild[group[at]] == at, next_wild[group[at]], best_wild[group[at]])
    parts.append((at, to, wilds[group[at]] - 1))
    at = np.flatnonzero(single & (wholes[group] > 0))
    parts.append((at, whole[group[at]], np.ones(len(at), np.int64)))
    at = np.flatnonzero(~wild & (singles[group] > 0))
    parts.append((at, best_single[group[at]], singles[group[at]]))
    at, to, near = (np.concatenate(column) for column in zip(*parts))
    rows, best = table.take(pa.array(at)), table.take(pa.array(to))
    columns = [rows.column("key"), rows.column("x"), rows.column("id"), pa.array(near, pa.int64()), pa.array(count[to], pa.int64()),
               best.column("x"), best.column("id")]
    found = pa.table(columns, names=["key", "x", "id", "near", "best_n", "best_x", "best_id"]).combine_chunks().to_batches()
    return found[0] if found else _NOTHING


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal keys in sorted rows; the last group of a batch, small as it is, waits for the next."""
    rest = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        key = table.column("key")
        last, end = table.num_rows - 1, key[table.num_rows - 1]
        while last > 0 and key[last - 1] == end:
            last -= 1
        rest = table.slice(last)
        if last:
            yield _group_neighbours(table.slice(0, last))
    if rest is not None:
        yield _group_neighbours(rest)


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best_word``: how many words are one edit apart, and the most frequent.

    ``words`` has ``word`` (distinct, no nulls) and ``n``; only words with a neighbour return.
    Pairs are counted within groups and never written out. Of equally frequent neighbours
    the first in code-point order counts.
    """
    in_order = rotations(words).repartition("key").sortWithinPartitions("key", F.col("n").desc(), "x")
    found = in_order.mapInArrow(_scan, _FOUND)
    names = words.where(F.char_length("word") > LITERAL).select(F.xxhash64("word").alias("ref"), F.col("word").alias("name"))

    def named(x: str) -> Column:
        return F.concat(F.substring_index("key", END, -1), x, F.substring_index("key", END, 1))

    short = found.where("id = 0 AND best_id = 0").select("near", "best_n", named("x").alias("word"), named("best_x").alias("best_word"))
    first = names.select(F.col("ref").alias("id"), F.col("name").alias("word"))
    second = names.select(F.col("ref").alias("best_id"), F.col("name").alias("best_word"))
    longer = found.where("id <> 0 AND best_id <> 0").join(first, "id").join(second, "best_id").select("near", "best_n", "word", "best_word")
    return (
        short.unionByName(longer)
        .groupBy("word")
        .agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best_word").alias("w"))).alias("best"))
        .select("word", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.w").alias("best_word"))
    )


def spelling_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = 7,
    least_count: int = 2,
    typos: int = 31,
    ratio: int = 10,
) -> DataFrame:
    """Every word with its standard form and the root of its group: ``word, form, root, n, n_near, form_n``.

    A word's form is its most frequent neighbour if that is at least ``ratio`` times as
    frequent; the root is where the forms lead in the end, or the word itself. Null texts,
    texts without letters and an empty table give no words; a null id counts as an empty one;
    rows that repeat an id count again. Words of any length are compared.
    """
    words = stage(word_counts(docs, id_col, text_col, least_length, least_count, typos), "words")
    near = stage(neighbours(words), "spelling-near")
    formed = near.join(words, "word").where(F.col("best_n") >= ratio * F.col("n"))
    forms = stage(formed.select("word", F.col("best_word").alias("form"), F.col("best_n").alias("form_n")), "forms")
    # Each step multiplies the count by the ratio, so the largest count bounds the length of a way.
    top = forms.agg(F.max("form_n").alias("n")).first()["n"] or 1
    ways = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(math.log(top, max(ratio, 2)) + 1)))):
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = stage(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "ways")
    return (
        words.join(near.select("word", "n_near"), "word", "left")
        .join(forms, "word", "left")
        .join(ways, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
    )
