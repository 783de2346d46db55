"""Benchmark passages in documents, by a positional inverted index. DataFrame functions only.

The index holds a posting (document row, position) for every occurrence of a benchmark word.
A passage is looked for from its rarest word: each posting of that word says where the passage
would begin; those beginnings are intersected with the postings of all other words, less their offsets.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baroflow.llm.spelling import ascii_lower
from baroflow.plans.staging import stage

#: Fixed value of the rule: what separates words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BROADCAST_BYTES = 32 << 20


class Index(NamedTuple):
    """``postings``: ``row, pos, term``; ``rows``: ``row``, the id and ``n_words``; ``terms``: ``word, term, count``."""

    postings: DataFrame
    rows: DataFrame
    terms: DataFrame


def words_of(text: Column) -> Column:
    """Words in order, not yet lower-cased; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _sized(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its counted rows fit a fixed number of bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def passages(items: DataFrame, window: int, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``passage, words`` and ``passage, item`` of the items that have them."""
    words = F.transform(words_of(F.col(text_col)), ascii_lower)
    given = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), words.alias("ws")).where(F.size("ws") > 0)
    size = F.least(F.lit(window), F.size("ws"))
    cut = given.select("item", "ws", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("ws") - size + 1)).alias("at"))
    raw = stage(cut.select("item", F.slice("ws", F.col("at"), F.col("size")).alias("words")).distinct(), "item-windows")
    distinct = stage(raw.select("words").distinct().withColumn("passage", F.monotonically_increasing_id()), "passages")
    return distinct, stage(raw.join(distinct, "words").select("passage", "item"), "passage-items")


def positional_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Postings of the words in ``vocabulary`` (column ``word``) over all documents, in one pass over the texts.

    The empty word stands at the end of every document and so gives its number of words.
    """
    known = vocabulary.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
    terms = stage(known.unionByName(vocabulary.sparkSession.createDataFrame([("", -1)], "word string, term long")), "terms")
    size = terms.agg(F.sum(F.octet_length("word") + 48)).first()[0]
    split = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.array_append(words_of(F.col(text_col)), F.lit("")).alias("ws")
    )
    tokens = split.select("row", "id", F.posexplode("ws").alias("pos", "token")).select("row", "id", "pos", ascii_lower(F.col("token")).alias("word"))
    found = tokens.join(F.broadcast(terms) if size <= BROADCAST_BYTES else terms, "word")
    stored = stage(found.select("row", "pos", "term", F.when(F.col("term") == -1, F.col("id")).alias("id")), "postings")
    ends = stored.where("term = -1")
    postings = stored.where("term >= 0").select("row", "pos", "term")
    counts = postings.groupBy("term").agg(F.count("*").alias("count"))
    counted = stage(terms.where("term >= 0").join(counts, "term", "left").select("word", "term", F.coalesce("count", F.lit(0)).alias("count")), "term-counts")
    return Index(postings, ends.select("row", F.col("id").alias(id_col), F.col("pos").cast("long").alias("n_words")), counted)


def ranked_terms(found: DataFrame, index: Index) -> DataFrame:
    """``passage, size, offset, term, rank`` of passages all of whose words occur, the rarest word first."""
    placed = found.select("passage", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word")).join(index.terms, "word")
    rarest_first = Window.partitionBy("passage").orderBy("count", "offset")
    own = Window.partitionBy("passage")
    ranked = placed.withColumn("rank", F.row_number().over(rarest_first)).withColumn("least", F.min("count").over(own))
    return stage(ranked.where("least > 0").select("passage", "size", "offset", "term", "rank"), "ranked-terms")


def phrase_matches(index: Index, ranked: DataFrame) -> DataFrame:
    """``row, passage, start, size`` of every exact occurrence.

    The rarest word's postings, less its offset, are the candidates. One join on (row, position,
    word) intersects them with the lists of all other words of their passages; no key of
    it repeats in the postings, so no word or passage, however frequent, is one task's work.
    """
    rarest = _sized(stage(ranked.where("rank = 1").select("passage", "size", "term", "offset"), "rarest"))
    others = ranked.where("rank > 1").select("passage", "term", "offset")
    at = (F.col("pos") - F.col("offset")).alias("start")
    begun = stage(index.postings.join(rarest, "term").select("row", "passage", "size", at).where("start >= 0"), "begun")
    wanted = begun.join(others, "passage").withColumn("pos", F.col("start") + F.col("offset")).drop("offset")
    met = index.postings.join(wanted, ["row", "pos", "term"]).groupBy("row", "passage", "start", "size").agg(F.count("*").alias("met"))
    return begun.where("size = 1").unionByName(met.where("met = size - 1").drop("met"))


def proximity_matches(index: Index, ranked: DataFrame, within: int) -> DataFrame:
    """``row, passage, start``: all words of a passage stand in the ``within`` words from ``start`` on.

    Order does not matter; a word that the passage repeats must stand there as often. Each
    match starts at one of the passage's words. Postings meet by blocks of ``within`` positions.
    """
    needs = ranked.groupBy("passage", "term").agg(F.count("*").alias("times"))
    kinds = needs.groupBy("passage").agg(F.count("*").alias("kinds"))
    rarest = ranked.where("rank = 1").select("passage", "term")
    block = F.floor(F.col("pos") / within)
    # Where the rarest word stands, and around it the other words; each may be where the match starts.
    anchors = stage(index.postings.join(rarest, "term").select("row", "passage", F.col("pos").alias("anchor")), "anchors")
    around = anchors.withColumn("block", F.explode(F.array(*[F.floor(F.col("anchor") / within) + d for d in (-1, 0, 1)])))
    close = index.postings.join(needs, "term").withColumn("block", block).join(around, ["row", "passage", "block"])
    close = stage(
        close.where(F.abs(F.col("pos") - F.col("anchor")) < within).select("row", "passage", "term", "times", "pos").distinct(), "close"
    )
    starts = close.select("row", "passage", F.col("pos").alias("start")).distinct()
    ahead = starts.withColumn("block", F.explode(F.array(*[F.floor(F.col("start") / within) + d for d in (0, 1)])))
    inside = close.withColumn("block", block).join(ahead, ["row", "passage", "block"]).where("pos >= start AND pos < start + " + str(int(within)))
    counted = inside.groupBy("row", "passage", "start", "term", "times").agg(F.count("*").alias("n")).where("n >= times")
    full = counted.groupBy("row", "passage", "start").agg(F.count("*").alias("n")).join(kinds, "passage").where("n = kinds")
    return full.select("row", "passage", "start")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """For every document: ``n_words``, ``n_hit``, ``n_items``, ``items`` (ids as sorted strings), ``contaminated``.

    A window is ``window`` consecutive words of an item, or all of a shorter item's; a document's
    word inside any occurrence of a window is hit. Null texts have no words; an item without
    words or with a null id takes no part; rows that repeat an item count once; a row that
    repeats a document's id, or has a null one, returns its own row. An empty table of items
    leaves every document clean; no documents, no rows.
    """
    found, members = passages(items, window, item_col, item_text_col)
    index = positional_index(docs, found.select(F.explode("words").alias("word")), id_col, text_col)
    matches = stage(phrase_matches(index, ranked_terms(found, index)), "matches")
    covered = matches.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    hit = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    held = matches.select("row", "passage").distinct().join(members, "passage").select("row", F.col("item").cast("string").alias("item"))
    listed = held.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return (
        index.rows.join(hit.join(listed, "row"), "row", "left")
        .select(
            F.col(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"),
        )
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )
