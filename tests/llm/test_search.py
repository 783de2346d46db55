"""Passages, spelling variants and ranked search against brute force, with odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from baroflow.llm.contamination import contamination, passages, positional_index, proximity_matches, ranked_terms
from baroflow.llm.lexical import ranked_search
from baroflow.llm.spelling import neighbours, spelling_groups
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, `Row` long, pos int, term string, word string, passage long"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return PLAIN.findall((text or "").translate(LOW))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, 1, "x", "y", 3) for i, t in rows], DOCS).repartition(3)


def sample(n=50, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcé9") for _ in range(rng.randint(1, 3))) for _ in range(30)] + ["the"] * 10
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "..."), (None, "the a b"), (3, items[3][1]), (3, "zz the"), (23, items[5][1].upper()), (24, "the the the")]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            passage = items[rng.randrange(12)][1].split(" ")
            text += " - " + ", ".join(passage[rng.randrange(len(passage)) :]) + ". " + text
        rows.append((i, text))
    rows += [(None, "the the the THE"), (4, "Zz, THE!"), (4, "Zz, THE!"), (60, None), (61, ""), (62, " \n"), (63, "the " * 20000), (64, "É é ñ" * 50)]
    return rows, items


def brute_contamination(rows, items, window=10):
    windows = {}
    for i, text in items:
        w = plain_words(text)
        size = min(window, len(w))
        if i is not None and size:
            for k in range(len(w) - size + 1):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w, hit, held = plain_words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k : k + size]))
                if found:
                    hit.update(range(k, k + size))
                    held |= found
        out.append((i, len(w), len(hit), len(held), tuple(sorted(held)), bool(hit)))
    return Counter(out)


def test_contamination(spark):
    rows, items = sample()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame(spark, rows), bench).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()
    assert Counter((*r[:4], tuple(r[4]), r[5]) for r in got) == brute_contamination(rows, items)


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = contamination(frame(spark, [(1, "a b"), (2, None)]), bench).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in got) == [(1, 2, 0, False), (2, 0, 0, False)]
    assert contamination(frame(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_proximity(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for i in range(12)] + [(50, None), (51, "a " * 500)]
    bench = spark.createDataFrame([(1, "a b c d"), (2, "e e f"), (3, "g"), (4, "a zebra")], "item_id long, text string")
    found, members = passages(bench, 4, "item_id", "text")
    index = positional_index(frame(spark, rows), found.select(F.explode("words").alias("word")))
    within = 6
    got = proximity_matches(index, ranked_terms(found, index), within).join(members, "passage").join(index.rows, "row")
    want = set()
    for item, text in ((1, "a b c d"), (2, "e e f"), (3, "g"), (4, "a zebra")):
        need = Counter(text.split())
        for i, t in rows:
            w = plain_words(t)
            for k, first in enumerate(w):
                if first in need and not need - Counter(w[k : k + within]):
                    want.add((i, item, k))
    assert want and {(r["doc_id"], r["item"], r["start"]) for r in got.collect()} == want


def brute_groups(rows, ratio=10, least=7):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: set() for w in n}
    for w in n:
        for v in n:
            if len(w) == len(v):
                if w != v and sum(a != b for a, b in zip(w, v)) == 1:
                    near[w].add(v)
            elif len(v) == len(w) - 1:
                k = next((k for k, (a, b) in enumerate(zip(w, v)) if a != b), len(v))
                if w[k + 1 :] == v[k:]:
                    near[w].add(v)
                    near[v].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def variants():
    rng = random.Random(1)
    rows = []
    for i in range(40):
        words = []
        for _ in range(40):
            words += ["".join(rng.choice("abé") for _ in range(rng.randint(6, 8)))] * rng.choice([1, 1, 12])
        rows.append((i, " ".join(words)))
    base = "".join(rng.choice("ab") for _ in range(300))
    for k in (63, 64, 65, 66, 67, 300):
        w = base[:k]
        forms = [(w, 30), (w[:5] + "c" + w[6:], 3), (w[:9] + w[10:], 2), (w + "a", 2), ("c" + w, 2), (w[:7] + w[7] + w[7:], 2)]
        rows.append((100 + k, " ".join(f for f, n in forms for _ in range(n))))
    rows.append((200, ("chainedd " * 4 + "chaineddd " * 44 + "chained " * 1) + "chainedddd " * 500))
    long = "x" * 20000
    rows += [(None, "Abcdefgh ÉÉÉÉÉÉÉÉ ééééééé " * 3), (5, None), (5, ""), (7, " ".join([long, long, long[1:], long[1:], "y" + long[1:], "y" + long[1:]]))]
    return rows


def test_spelling_groups(spark):
    rows = variants()
    got = spelling_groups(frame(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = brute_groups(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert spelling_groups(frame(spark, [])).count() == 0
    assert spelling_groups(frame(spark, [(1, None), (2, "short words")])).count() == 0


def test_neighbours_of_one_key_in_several_batches(spark):
    """A group that a batch boundary cuts is still one group."""
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    words = spark.createDataFrame([("pre" + x + "fix", 1 + k) for k, x in enumerate(letters)] + [("prefix", 2)], "word string, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["word"]: (r["n_near"], r["best_n"], r["best_word"]) for r in neighbours(words).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["prefix"] == (26, 26, "prezfix") and got["prezfix"] == (26, 25, "preyfix") and len(got) == 27


def brute_search(rows, items, k=10):
    docs = [(i, Counter(plain_words(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(plain_words(text))
    out = set()
    for item, terms in asked.items():
        scored = []
        for i, c in docs:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in terms & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score:
                scored.append((-score, i is None, i or 0, i))
        out |= {(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("query_bytes", [1 << 18, 60])
def test_ranked_search(spark, query_bytes):
    rows, items = sample(80, 4)
    rows += [(200 + i, t) for i, t in rows[:20]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = ranked_search(frame(spark, rows), bench, query_bytes=query_bytes).select("item_id", "rank", "doc_id", "score").collect()
    want = brute_search(rows, items)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_ranked_search_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    assert ranked_search(frame(spark, []), bench).count() == 0
    assert ranked_search(frame(spark, [(1, None), (2, "c")]), bench).count() == 0
    assert ranked_search(frame(spark, [(1, "a")]), bench.limit(0)).count() == 0
