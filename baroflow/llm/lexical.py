"""Ranked lexical search: documents of a block grouped by which of an item's terms they hold.

A block of documents keeps a bitmap per term. The bitmaps of an item's terms, turned over, give
each document's presence mask; documents with the same mask form a group, whose score is bounded
by the weights of the mask's terms. Groups are scored by descending bound until no other group
can reach the item's ``k`` best documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baroflow.llm.common import parts_for, text_bytes
from baroflow.llm.words import chunks, words
from baroflow.plans.staging import stage

#: Bytes of terms: ASCII letters and digits and every byte of a non-ASCII character.
TERM = np.zeros(256, bool)
TERM[ord("0") : ord("9") + 1] = TERM[ord("a") : ord("z") + 1] = TERM[ord("A") : ord("Z") + 1] = TERM[128:] = True

#: Fixed values of the score: length and frequency constants, in thousandths and millionths.
LENGTH_SHARE, SATURATION, UNIT = 90, 8, 1_000_000_000

BLOCK_ROWS = 2048
_POSTINGS = "block binary, n_docs long, n_terms long"
_FOUND = "item long, score long, doc_id long"


class Items(NamedTuple):
    """Some query items: distinct terms in order, and each item's terms as numbers of those."""

    ids: list
    terms: np.ndarray
    rows: list[np.ndarray]


class Block(NamedTuple):
    """Documents' postings of the query terms: of document ``doc[i]``, term ``term[i]`` ``tf[i]`` times."""

    ids: np.ndarray
    known: np.ndarray
    n: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def pack_items(texts: list[tuple[object, str | None]]) -> Items:
    """Items by id; rows that repeat an id are one item with the terms of all of them."""
    found: dict[object, list[np.ndarray]] = {}
    for item, text in texts:
        hashes = [words(chunk, TERM).hashes for chunk in chunks(pa.array([text], pa.string()))]
        found.setdefault(item, []).extend(hashes)
    each = [np.unique(np.concatenate(parts)) for parts in found.values()]
    terms = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]))
    return Items(list(found), terms, [np.searchsorted(terms, hashes) for hashes in each])


def _save(block: Block) -> bytes:
    head = np.array([len(block.ids), len(block.doc)], np.int64)
    return b"".join(
        [head.tobytes(), block.ids.astype(np.int64).tobytes(), block.n.astype(np.int64).tobytes(), block.known.astype(np.uint8).tobytes(),
         block.doc.astype(np.uint16).tobytes(), block.term.astype(np.int32).tobytes(), block.tf.astype(np.int32).tobytes()]
    )


def _load(data: bytes) -> Block:
    docs, postings = np.frombuffer(data, np.int64, 2)
    at, out = 16, []
    for kind, size in ((np.int64, docs), (np.int64, docs), (np.uint8, docs), (np.uint16, postings), (np.int32, postings), (np.int32, postings)):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    ids, n, known, doc, term, tf = out
    return Block(ids, known.astype(bool), n, doc, term, tf)


def _indexer(terms: np.ndarray) -> Callable:
    """Blocks of documents as postings of the query terms."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Block] = []

        def flush() -> pa.RecordBatch:
            before = np.cumsum([0] + [len(b.ids) for b in waiting])
            whole = Block(*(np.concatenate(column) for column in zip(*(b._replace(doc=b.doc + at) for b, at in zip(waiting, before)))))
            waiting.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([_save(whole)], pa.binary()), pa.array([int((whole.n > 0).sum())], pa.int64()), pa.array([int(whole.n.sum())], pa.int64())],
                names=["block", "n_docs", "n_terms"],
            )

        for batch in batches:
            ids = batch.column("id")
            known = np.asarray(ids.is_valid())
            numbers = ids.fill_null(0).to_numpy()
            start = 0
            for chunk in chunks(batch.column("text")):
                found = words(chunk, TERM)
                per = np.diff(found.first)
                place = np.searchsorted(terms, found.hashes)
                hit = np.append(terms, np.uint64(0))[place] == found.hashes if len(terms) else np.zeros(len(place), bool)
                hit &= place < len(terms)
                key = np.repeat(np.arange(len(per)), per)[hit] * max(len(terms), 1) + place[hit]
                key, tf = np.unique(key, return_counts=True)
                doc, term = np.divmod(key, max(len(terms), 1))
                for low in range(0, len(per), BLOCK_ROWS):
                    high = min(low + BLOCK_ROWS, len(per))
                    some = slice(*np.searchsorted(doc, [low, high]))
                    at = slice(start + low, start + high)
                    waiting.append(Block(numbers[at], known[at], per[low:high], doc[some] - low, term[some], tf[some]))
                    if sum(len(b.ids) for b in waiting) + BLOCK_ROWS > 2 * BLOCK_ROWS:
                        yield flush()
                start += len(per)
        if waiting:
            yield flush()

    return index


def _masks(bits: np.ndarray, rows: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct presence masks of an item's terms (as rows of 0 and 1), and the documents of each.

    Returns masks, documents ordered by mask, and where each mask's documents begin.
    """
    present = np.unpackbits(bits[rows], axis=1, count=docs)
    turned = np.ascontiguousarray(np.packbits(present, axis=0).T)
    any_term = np.flatnonzero(turned.any(axis=1))
    turned = turned[any_term]
    if not len(turned):
        return np.zeros((0, len(rows))), any_term, np.zeros(1, np.int64)
    order = np.lexsort(turned.T)
    ordered = turned[order]
    new = np.flatnonzero(np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)]))
    return np.unpackbits(ordered[new], axis=1, count=len(rows)).astype(np.int64), any_term[order], np.append(new, len(order))


def _searcher(items: Items, weight: np.ndarray, n_docs: int, n_terms: int, k: int, number: int) -> Callable:
    """Each item's ``k`` best documents of a task's blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items.ids]

        def better(i: int, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
            score, ids, known = (np.concatenate(pair) for pair in zip(best[i], (score, ids, known)))
            order = np.lexsort((ids, ~known, -score))[:k]
            best[i] = (score[order], ids[order], known[order])

        for batch in batches:
            for data in batch.column("block").to_pylist():
                block = _load(data)
                docs = len(block.ids)
                m = 100 - LENGTH_SHARE + (LENGTH_SHARE * block.n * n_docs) // max(n_terms, 1)
                order = np.argsort(block.term, kind="stable")
                term, doc, tf = block.term[order], block.doc[order].astype(np.int64), block.tf[order].astype(np.int64)
                impact = weight[term] * ((UNIT * tf) // (1000 * tf + SATURATION * m[doc]))
                used, at = np.unique(term, return_index=True)
                if not len(used):
                    continue
                end = np.append(at[1:], len(term))
                # Bitmaps, and each term's highest impact in this block.
                bits = np.zeros((len(used), -(-docs // 8)), np.uint8)
                np.bitwise_or.at(bits, (np.repeat(np.arange(len(used)), end - at), doc >> 3), (128 >> (doc & 7)).astype(np.uint8))
                highest = np.maximum.reduceat(impact, at)
                place = np.full(len(items.terms), -1, np.int64)
                place[used] = np.arange(len(used))
                for i, own in enumerate(items.rows):
                    rows = place[own]
                    rows = rows[rows >= 0]
                    least = best[i][0][-1] if len(best[i][0]) == k else 1
                    if not len(rows) or highest[rows].sum() < least:
                        continue
                    masks, members, first = _masks(bits, rows, docs)
                    bound = masks @ highest[rows]
                    queue = np.argsort(-bound, kind="stable")
                    sizes = np.diff(first)[queue]
                    done, wave = 0, 4 * k
                    while done < len(queue) and bound[queue[done]] >= (best[i][0][-1] if len(best[i][0]) == k else 1):
                        stop = done + max(1, int(np.searchsorted(np.cumsum(sizes[done:]), wave, "right")))
                        groups = queue[done:stop]
                        chosen = np.concatenate([members[first[g] : first[g + 1]] for g in groups])
                        score = np.zeros(len(chosen), np.int64)
                        for r in rows:
                            held = doc[at[r] : end[r]]
                            where = np.minimum(np.searchsorted(held, chosen), len(held) - 1)
                            score += np.where(held[where] == chosen, impact[at[r] : end[r]][where], 0)
                        keep = score > 0
                        better(i, score[keep], block.ids[chosen[keep]], block.known[chosen[keep]])
                        done, wave = stop, wave * 2
        for i, (score, ids, known) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), number + i), pa.int64()), pa.array(score, pa.int64()), pa.array(ids, pa.int64(), mask=~known)],
                    names=["item", "score", "doc_id"],
                )

    return search


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of a task each term occurs."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for data in batch.column("block").to_pylist():
            n = np.bincount(_load(data).term)
            total = np.pad(total, (0, max(0, len(n) - len(total))))
            total[: len(n)] += n
    term = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(total[term], pa.int64())], names=["term", "df"])


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    query_bytes: int = 1 << 18,
) -> DataFrame:
    """Each item's ``k`` highest-scoring documents: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters and digits and of all non-ASCII characters, A-Z
    lower-cased. Null texts have no terms; documents without terms are not counted; an item
    without terms, or whose terms no document holds, has no rows, nor has an empty table. Rows
    that repeat an item's id are one item with the terms of all. Documents that repeat an
    id each take a rank; of equal scores the smaller id comes first, a null id last.

    Items are worked off in blocks of about ``query_bytes`` of text, which bounds what a task is
    sent; each block's index (postings of the block's terms alone) and results are written
    before the next begins.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = parts_for(text_bytes(asked), query_bytes)
    results = spark.createDataFrame([], f"item_id {kind}, score long, doc_id long")
    for number in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).collect()
        packed = pack_items([(row["item"], row["text"]) for row in part])
        if not len(packed.terms):
            continue
        index = stage(rows.mapInArrow(_indexer(packed.terms), _POSTINGS), "postings")
        total = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
        if not total["docs"]:
            continue
        df = np.zeros(len(packed.terms), np.int64)
        for row in index.mapInArrow(_counter, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[row["term"]] = row["df"]
        weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        first = number << 32
        found = stage(index.mapInArrow(_searcher(packed, weight, total["docs"], total["terms"], k, first), _FOUND), "ranked")
        names = spark.createDataFrame([(first + i, item) for i, item in enumerate(packed.ids)], f"item long, item_id {kind}")
        results = results.unionByName(found.join(names, "item").select("item_id", "score", "doc_id"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Two steps, so that an item with parts from very many tasks is not one task's work.
    results = results.withColumn("part", F.spark_partition_id() % 64)
    near, all_of = Window.partitionBy("item_id", "part").orderBy(*order), Window.partitionBy("item_id").orderBy(*order)
    return (
        results.withColumn("rank", F.row_number().over(near))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(all_of))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )
