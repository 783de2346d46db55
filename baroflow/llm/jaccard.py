"""Jaccard join of word-shingle sets with count vectors in an R-tree.

Shingles are hashed into groups; a document is the point of its group counts. The sum of
coordinate minima of two points bounds the overlap of their sets from above, and so does
the sum of minima of two boxes' upper corners for every pair of points in them.

In many dimensions all boxes of one tree over all documents overlap, so one tree would
compare nearly all pairs. Documents therefore meet first at rare shingles: two sets with
similarity t share one of the first n - ceil(t n) + 1 shingles of each in any common order.
The order puts shingles in frequently hit slots of a fixed-size counter table last. At
each shared shingle members are first compared with one hub only, which joins groups of
near copies without listing their pairs; then an R-tree over the count vectors finds the
pairs between different components that are left. Survivors of the bound are verified on
their whole sets. The result is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from baroflow.llm.common import few
from baroflow.llm.components import components
from baroflow.llm.words import Chunk, Words, chunks, mix, words
from baroflow.plans.staging import stage

LEAF = 32
LEAST_GROUPS = 32
_SLOT_BITS, _SLICES = 20, 64
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_TOP = np.uint64(1 << 63)


# -- sets -----------------------------------------------------------------------------------


def shingles(chunk: Chunk, found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 63-bit hash of every shingle; a row with fewer words has its whole sequence as one."""
    h, first = found.hashes, found.first
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    n = len(h) - width + 1
    if n > 0:
        value = np.zeros(n, np.uint64)
        for j in range(width):
            value += h[j : j + n] * _FACTORS[j]
        whole = np.arange(n) + width <= first[row[:n] + 1]
        rows, values = row[:n][whole], value[whole]
    else:
        rows, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        value = count[short].astype(np.uint64) * _FACTORS[63]
        for j in range(width - 1):
            has = count[short] > j
            value[has] += h[first[short[has]] + j] * _FACTORS[j]
        rows, values = np.concatenate([rows, short]), np.concatenate([values, value])
    return rows, mix(values) >> np.uint64(1)


def _sets(texts, width: int, hot: np.ndarray | None = None):
    """Per chunk: number of rows, and row and key of each distinct shingle, sorted by row and key."""
    for chunk in chunks(texts):
        rows, keys = shingles(chunk, words(chunk), width)
        if hot is not None:
            keys = np.where(hot[_slot(keys)], keys | _TOP, keys)
        order = np.lexsort((keys, rows))
        rows, keys = rows[order], keys[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
        yield chunk.start, len(chunk.offsets) - 1, rows[new], keys[new]


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys & ~_TOP) >> np.uint64(63 - _SLOT_BITS)).astype(np.int64)


def groups_for(n):
    """Groups that a set of ``n`` shingles is hashed into: a power of two, so that a point with
    twice as many coordinates as another folds onto it, and one or two shingles a group."""
    return np.maximum(LEAST_GROUPS, 1 << np.ceil(np.log2(np.maximum(n, 1) / 2)).clip(0).astype(np.int64))


def count_vector(keys: np.ndarray) -> np.ndarray:
    groups = int(groups_for(len(keys)))
    return np.bincount((keys & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def pack_counts(vector: np.ndarray) -> bytes:
    return vector.astype(np.uint8 if vector.max() < 256 else np.uint32).tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == groups_for(n) else np.uint32).astype(np.int32)


def folded(vectors: list[np.ndarray]) -> np.ndarray:
    """The points as a matrix, all folded onto the fewest coordinates among them."""
    width = min(map(len, vectors))
    return np.stack([v if len(v) == width else v.reshape(-1, width).sum(0) for v in vectors])


def _slot_counter(width: int):
    def run(batches):
        total = np.zeros(1 << _SLOT_BITS, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                total += np.bincount(_slot(shingles(chunk, words(chunk), width)[1]), minlength=len(total))
        parts = total.astype(np.uint32).reshape(_SLICES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(_SLICES)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "counts"]
        )

    return run


def _slot_sums(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            one = np.frombuffer(data.as_buffer(), np.uint32).astype(np.int64)
            sums[k] = sums[k] + one if k in sums else one
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
        names=["slice", "counts"],
    )


def hot_slots(texts: DataFrame, width: int) -> np.ndarray:
    """Which of the fixed number of slots hold far more shingles than the mean one (8 MB to the driver)."""
    rows = (
        texts.mapInArrow(_slot_counter(width), "slice long, counts binary")
        .repartition(_SLICES, "slice")
        .mapInArrow(_slot_sums, "slice long, counts binary")
        .collect()
    )
    total = np.zeros((_SLICES, (1 << _SLOT_BITS) // _SLICES), np.int64)
    for r in rows:
        total[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    total = total.ravel()
    return total >= max(8.0, 4 * total.mean())


def _profiler(width: int, percent: int, hot):
    """id, size and fingerprint of each set, and the keys at which it meets others."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for start, n_rows, rows, keys in _sets(batch.column(1), width, hot.value):
                n = np.bincount(rows, minlength=n_rows)
                begin = np.cumsum(n) - n
                prints = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(keys ^ np.uint64(salt)), dtype=np.uint64)])
                    prints.append((sums[begin + n] - sums[begin]).view(np.int64))
                prefix = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                rank = np.arange(len(keys)) - begin[rows]
                used = keys[rank < prefix[rows]].view(np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(prefix)]), pa.int32()), pa.array(used)
                )
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, n_rows), pa.array(n), pa.array(prints[0]), pa.array(prints[1]), lists],
                    names=["id", "n", "fp1", "fp2", "keys"],
                )

    return run


def _vectoriser(width: int):
    def run(batches):
        for batch in batches:
            for start, n_rows, rows, keys in _sets(batch.column(1), width):
                ends = np.searchsorted(rows, np.arange(n_rows + 1))
                own = [keys[a:b] for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, n_rows),
                        pa.array([len(k) for k in own], pa.int64()),
                        pa.array([pack_counts(count_vector(k)) for k in own], pa.binary()),
                    ],
                    names=["id", "n", "vector"],
                )

    return run


# -- bound, tree, verification -----------------------------------------------------------------


def can_reach(overlap, n_a, n_b, percent: int):
    """Whether sets of these sizes with at most this overlap can be similar enough."""
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def _overlap(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sum of coordinate minima of each pair of points."""
    out = np.empty(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        if len(x) != len(y):
            x, y = folded([x, y])
        out[i] = np.minimum(x, y).sum()
    return out


def _bound(percent: int):
    def run(batches):
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("na", "nb"))
            a, b = (
                [unpack_counts(v, n) for v, n in zip(batch.column(c).to_pylist(), sizes)]
                for c, sizes in (("va", n_a), ("vb", n_b))
            )
            ok = can_reach(_overlap(a, b), n_a, n_b, percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


class CountTree:
    """R-tree over count vectors, bulk-loaded by halving along the widest coordinate."""

    def __init__(self, points: np.ndarray, members: np.ndarray | None = None):
        members = np.arange(len(points)) if members is None else members
        own = points[members]
        self.members, self.upper, self.least = members, own.max(0), int(own.sum(1).min())
        self.children: list[CountTree] = []
        if len(members) > LEAF:
            axis = int((own.max(0) - own.min(0)).argmax())
            order = members[np.argsort(own[:, axis], kind="stable")]
            half = len(order) // 2
            self.children = [CountTree(points, order[:half]), CountTree(points, order[half:])]


def tree_pairs(points: np.ndarray, percent: int):
    """Index pairs (i < j) whose sum of coordinate minima leaves them a chance."""
    n = points.sum(1)
    root = CountTree(points)
    todo = [(root, root)]
    while todo:
        p, q = todo.pop()
        if not can_reach(int(np.minimum(p.upper, q.upper).sum()), p.least, q.least, percent):
            continue
        if p is q and p.children:
            left, right = p.children
            todo += [(left, left), (right, right), (left, right)]
        elif p.children and (not q.children or len(p.members) >= len(q.members)):
            todo += [(c, q) for c in p.children]
        elif q.children:
            todo += [(p, c) for c in q.children]
        else:
            i, j = p.members, q.members
            low = np.minimum(points[i][:, None, :], points[j][None, :, :]).sum(2)
            ok = can_reach(low, n[i][:, None], n[j][None, :], percent)
            if p is q:
                ok &= np.tri(len(i), k=-1, dtype=bool).T
            x, y = np.nonzero(ok)
            yield np.minimum(i[x], j[y]), np.maximum(i[x], j[y])


def _by_width(points: list[np.ndarray], percent: int):
    """:func:`tree_pairs` with a tree for each number of coordinates, which also holds the points
    with twice as many; sizes further apart cannot be similar enough (``percent`` over 50)."""
    width = np.array([len(p) for p in points])
    for w in np.unique(width):
        own = np.flatnonzero((width == w) | (width == 2 * w))
        if len(own) > 1:
            for x, y in tree_pairs(folded([points[k] for k in own]), percent):
                x, y = own[x], own[y]
                least = np.minimum(width[x], width[y]) == w
                yield x[least], y[least]


def _cells(batches, columns):
    """The rows of one cell at a time from batches sorted by cell; a cell's size is bounded."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        part = []
        for c in columns:
            values = batch.column(c).to_pylist()
            own = np.empty(len(values), object if c in ("vector", "keys") else np.int64)
            own[:] = values
            part.append(own)
        held = part if held is None else [np.concatenate([x, y]) for x, y in zip(held, part)]
        key = np.stack([held[0], held[1], held[2]])
        edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for a, b in zip([0, *edges], edges):
            yield [x[a:b] for x in held]
        last = edges[-1] if len(edges) else 0
        held = [x[last:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _tree_join(percent: int):
    """Pairs of each cell that the bound leaves, between different components and, in a cell
    of two blocks, between the blocks. A few members are compared one by one. A pair that
    meets in several cells comes from that of its smallest common key only."""
    columns = ["key", "i", "j", "id", "component", "side", "n", "keys", "vector"]

    def run(batches):
        out_a, out_b = [], []
        for key, i, j, ids, comp, side, n, keys, vectors in _cells(batches, columns):
            crossed, own = i[0] != j[0], int(key[0])
            wanted = lambda x, y: (comp[x] != comp[y]) & (crossed <= (side[x] != side[y]))
            if len(ids) <= LEAF:
                x, y = np.triu_indices(len(ids), 1)
                ok = wanted(x, y) & can_reach(np.minimum(n[x], n[y]), n[x], n[y], percent)
                x, y = x[ok], y[ok]
                points = [unpack_counts(v, k) for v, k in zip(vectors, n)] if len(x) else []
                ok = can_reach(_overlap([points[k] for k in x], [points[k] for k in y]), n[x], n[y], percent)
                pairs = [(x[ok], y[ok])]
            else:
                points = [unpack_counts(v, k) for v, k in zip(vectors, n)]
                pairs = [(x[ok], y[ok]) for x, y in _by_width(points, percent) if (ok := wanted(x, y)).any()]
            for x, y in pairs:
                first = [min(set(keys[a]).intersection(keys[b])) == own for a, b in zip(x, y)]
                x, y = x[np.array(first, bool)], y[np.array(first, bool)]
                out_a.append(np.minimum(ids[x], ids[y]))
                out_b.append(np.maximum(ids[x], ids[y]))
            if len(out_a) > 1000:
                yield _pairs(out_a, out_b)
                out_a, out_b = [], []
        yield _pairs(out_a, out_b)

    return run


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], names=["a", "b"]
    )


def _verifier(width: int, percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = part.num_rows
                rows, keys, size = [], [], []
                for name in ("ta", "tb"):
                    got = [(s + r, k) for s, _, r, k in _sets(part.column(name), width)]
                    r = np.concatenate([x[0] for x in got])
                    rows.append(r)
                    keys.append(np.concatenate([x[1] for x in got]))
                    size.append(np.bincount(r, minlength=n))
                rows, keys = np.concatenate(rows), np.concatenate(keys)
                order = np.lexsort((keys, rows))
                rows, keys = rows[order], keys[order]
                both = (rows[1:] == rows[:-1]) & (keys[1:] == keys[:-1])
                common = np.bincount(rows[1:][both], minlength=n)
                ok = 100 * common >= percent * (size[0] + size[1] - common)
                yield part.select(["a", "b"]).filter(pa.array(ok & (common > 0)))

    return run


# -- the join -----------------------------------------------------------------------------------


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    cell_rows: int = 2048,
    broadcast_ids: int = 1_000_000,
) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased. Rows link when
    100 * intersection >= ``percent`` * union of their sets of distinct shingles; a row with
    fewer than ``width`` words has its whole sequence as one shingle. Null, empty and blank
    texts have no shingle, link with nothing and keep their own id. Ids are integers; rows
    with a null id are left out, rows that repeat an id come out once each and count as one
    node. An empty table gives no rows.

    Equal sets are one class, compared through its smallest id. A shared shingle with more
    than ``cell_rows`` members is compared in cells of about that many. The list of rows that
    share a rare shingle with another one is broadcast while it has at most
    ``broadcast_ids`` ids (8 MB), else joined by shuffle.
    """
    if percent <= 50:
        raise ValueError("percent must be over 50")
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_slots(texts.select("text"), width))
    profile = stage(
        texts.mapInArrow(_profiler(width, percent, hot), "id long, n long, fp1 long, fp2 long, keys array<long>"), "profile"
    )
    same = ["fp1", "fp2", "n"]
    classes = profile.where("n > 0").groupBy(*same).agg(F.min("id").alias("rep"))
    reps = profile.where("n > 0").join(classes.select(F.col("rep").alias("id"), *same), ["id", *same], "left_semi")

    shared = stage(_shared_keys(reps, percent), "shared")
    involved = shared.select("id").distinct()
    involved = stage(involved, "involved")
    points = stage(
        texts.join(few(involved, broadcast_ids), "id", "left_semi").mapInArrow(
            _vectoriser(width), "id long, n long, vector binary"
        ),
        "points",
    )

    def with_ends(pairs: DataFrame, *columns: str, of: DataFrame = points) -> DataFrame:
        for end in "ab":
            own = of.select(F.col("id").alias(end), *[F.col(c).alias(c[0] + end) for c in columns])
            pairs = pairs.join(own, end)
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        ends = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
        whole = stage(texts.join(few(ends, broadcast_ids), "id", "left_semi"), "whole")
        return (
            with_ends(pairs, "text", of=whole)
            .select("a", "b", "ta", "tb")
            .mapInArrow(_verifier(width, percent), "a long, b long")
        )

    stars = stage(shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    sized = with_ends(stars, "n").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    near = with_ends(sized, "n", "vector").select("a", "b", "na", "nb", "va", "vb").mapInArrow(_bound(percent), "a long, b long")
    links = stage(verified(stage(near, "survivors")), "links")
    joined = components(links)
    left = stage(_left_over(shared, joined, cell_rows), "cells")
    lists = left.groupBy("id").agg(F.collect_set("key").alias("keys"))
    left = left.join(points.join(lists, "id"), "id")
    cell = ["key", "i", "j"]
    more = (
        left.select(*cell, "id", "component", "side", "n", "keys", "vector")
        .repartition(*cell)
        .sortWithinPartitions(*cell)
        .mapInArrow(_tree_join(percent), "a long, b long")
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    more = stage(verified(stage(more, "survivors")), "links")
    if not more.isEmpty():
        joined = components(links.union(more))
    named = classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(
        *same, F.coalesce("component", "rep").alias("component_id")
    )
    return profile.select("id", *same).join(named, same, "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def _shared_keys(reps: DataFrame, percent: int) -> DataFrame:
    """``key, id, hub`` of every key with more than one member; the hub is the smallest member.

    Members whose sizes lie too far apart cannot be similar, so where the sizes of a key's
    members leave a gap of that width, the members on its two sides are parted under keys
    of their own. No pair that could link is parted.

    Keys of slots that are hit often (negative as signed numbers) are counted by an
    aggregate over size classes and joined back, which Spark can split; of the others none
    has more than a small share of the rows, so sorts find their groups.
    """
    keyed = reps.select(F.explode("keys").alias("key"), "id", "n")
    by_size = Window.partitionBy("key")
    part = F.xxhash64("key", "part").alias("key")

    # A class is a little wider than the sizes that may link, so these lie in the same or the next one.
    width = math.log(101 / percent)
    common = keyed.where("key < 0").withColumn("class", F.floor(F.log("n") / width).cast("int"))
    hubs = _parted(
        common.groupBy("key", "class").agg(F.min("id").alias("low"), F.max("id").alias("high")),
        by_size.orderBy("class"),
        F.col("class") - F.lag("class").over(by_size.orderBy("class")) > 1,
    )
    rare = (
        keyed.where("key >= 0")
        .withColumns({"low": F.min("id").over(by_size), "high": F.max("id").over(by_size)})
        .where("low < high")
        .withColumns({"low": F.col("id"), "high": F.col("id")})
    )
    rare = _parted(rare, by_size.orderBy("n"), percent * F.col("n") > 100 * F.lag("n").over(by_size.orderBy("n")))
    return rare.select(part, "id", "hub").union(common.join(hubs, ["key", "class"]).select(part, "id", "hub"))


def _parted(rows: DataFrame, order: WindowSpec, gap: Column) -> DataFrame:
    """``rows`` (with their least and greatest id ``low, high``) of the parts with two members or
    more, with the number ``part`` of gaps before it and its smallest member ``hub``."""
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("key", "part")
    return (
        rows.withColumn("part", F.coalesce(gap.cast("int"), F.lit(0)))
        .withColumn("part", F.sum("part").over(upto))
        .withColumns({"hub": F.min("low").over(own), "top": F.max("high").over(own)})
        .where("hub < top")
    )


def _left_over(shared: DataFrame, joined: DataFrame, cell_rows: int) -> DataFrame:
    """Members of the keys at which more than one component still meets, in cells of bounded size.

    Keys with the same members give the same pairs, so one of them is enough. Versions of
    one text meet at many keys, each time a few others of them: keys with the same smallest
    and largest member form one cell as long as their members together are few. A key with
    many members is cut into blocks, and each pair of blocks is a cell.
    """
    members = shared.select("key", "id").join(joined, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component")
    )
    members = stage(members, "members")
    ends = ["first", "last"]
    few_keys = F.ceil(F.sum("size").over(Window.partitionBy(*ends)) / cell_rows)
    keys = (
        members.groupBy("key")
        .agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"),
            F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("print"),
            F.min("id").alias("first"), F.max("id").alias("last"),
        )
        .where("low < high and size > 2")  # a pair is a hub and its one member, compared before
        .groupBy("size", "print", *ends, "low", "high")
        .agg(F.min("key").alias("key"))
        .withColumn("blocks", F.ceil(F.col("size") / cell_rows).cast("int"))
        .withColumn("bundle", F.xxhash64(*ends, F.pmod(F.xxhash64("key"), few_keys)))
        .select("key", "blocks", F.when(F.col("blocks") == 1, F.col("bundle")).otherwise(F.col("key")).alias("cell"))
    )
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return (
        members.join(keys, "key")
        .select(F.col("cell").alias("key"), "id", "component", "blocks")
        .distinct()
        .withColumn("side", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", "id", "component", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")
        )
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have a similar row with a smaller id in their component."""
    gone = jaccard_components(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id"))
    gone = few(stage(gone.select(F.col(id_col).alias("_gone_id")).distinct(), "gone"), 1_000_000)
    return docs.join(gone, docs[id_col] == gone["_gone_id"], "left_anti")
