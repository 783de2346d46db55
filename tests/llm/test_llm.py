"""Operators of the training-data subpackage against brute force, with odd rows."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from baroflow.llm.common import fold
from baroflow.llm.jaccard import jaccard_components
from baroflow.llm.exact import drop_exact_copies, exact_dedup
from baroflow.llm.lm import lm_scores
from baroflow.llm.mixing import entropy, find_exponent, mix, weights
from baroflow.llm.pii import base_spans, luhn, pii_spans
from baroflow.llm.quality import keep_good, quality_scores
from baroflow.llm.templates import Page, main_text
from baroflow.llm.topk import top_k
from baroflow.llm import toxicity
from baroflow.llm.toxicity import maximal_segments, toxic_scores
from baroflow.llm.words import chunks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^ \t-\r]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def documents(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    rows = []
    for i in range(n):
        if i % 4 == 3:
            text = list(rows[rng.randrange(len(rows))][1] or "x")
            text = "".join(text).split(" ")
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
            text = " ".join(text)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))
        rows.append((i, text, "en", rng.choice(["a", "a", "b", None]), len(text)))
    odd = [None, "", " \n\t ", "One Two", "one\ttwo", "A  b c", "word " * 3000, "x" * 50000, " nbsp 　wide"]
    rows += [(n + k, t, None, None, None) for k, t in enumerate(odd)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_components(docs, empty):
    sets = {i: shingle_set(t) for i, t, *_ in documents()}
    component = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            low, high = sorted((component[a], component[b]))
            component = {i: low if c == high else c for i, c in component.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, cell_rows=4).collect()}
    assert got == {i: (len(s), component[i]) for i, s in sets.items()}
    assert jaccard_components(empty).count() == 0


def test_exact_dedup(spark, docs, empty):
    rows = documents()
    norm = {i: re.sub("[ \t-\r]+", "", t or "") for i, t, *_ in rows}
    got = {r["doc_id"]: r for r in exact_dedup(docs, fan_in=2).collect()}
    for i, t, *_ in rows:
        group = [(-len(u or ""), j) for j, u, *_ in rows if norm[j] == norm[i]]
        assert got[i]["keep_id"] == min(group)[1] and got[i]["group_size"] == len(group)
        assert got[i]["kept"] == (min(group)[1] == i)
        assert got[i]["text_sha256"] == hashlib.sha256(norm[i].encode()).hexdigest()
    assert drop_exact_copies(docs).count() == len(set(norm.values()))
    assert exact_dedup(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r["group_size"], r["kept"]) for r in exact_dedup(twice).collect()) == [(1, True), (1, True), (2, False), (2, True)]


def test_lm_scores(docs, empty):
    rows = documents()
    count, n = Counter(), 0
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*words(t), None])
    total, types = sum(count.values()), len(count)
    for r in lm_scores(docs, block_bytes=5000, bucket_bytes=5000).collect():
        tokens = [*words(rows[r["doc_id"]][1]), None]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens)
        assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == total and r["n_tokens"] == len(tokens)
        assert r["n_known"] == sum(count[w] > 0 for w in tokens) and r["score"] < 0
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        n += 1
    assert n == len(rows) and lm_scores(empty).count() == 0


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(150)] + [(150, [0.5] * 8), (151, [0.5] * 8)]
    bad = [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    whole = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:10]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    got = top_k(df, df.where("vec_id % 50 = 0"), query_chunk=2, cells=200)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert top_k(df, df.where("false")).count() == 0
    # Many equal rows of one id, in several blocks and slices: each takes a rank.
    many = df.unionByName(spark.range(60).selectExpr("7L AS vec_id", "array_repeat(cast(2 AS float), 8) AS embedding").repartition(5))
    got = top_k(many, df.where("vec_id % 50 = 0"), query_chunk=1, slice_rows=7, cells=200)
    rows = rows + [(7, [2.0] * 8)] * 60
    pairs = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows]
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), c) for c, v in pairs if c != q)[:10]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_base_spans_and_operator(docs, spark, empty):
    text = "mail a.b@c.org, ip 10.0.0.256 1.2.3.4 card 4111 1111 1111 1111 tel +1 (212) 555-1234 ssn 123-45-6789"
    assert [text[a:b] for a, b, k in sorted(base_spans(text))] == ["a.b@c.org", "1.2.3.4", "4111 1111 1111 1111", "+1 (212) 555-1234"]
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "a@b.c")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii_spans(df).collect()}
    assert [s["kind"] for s in got[1] if s["base"]] == ["email", "ip", "card", "phone"] and got[2] == [] == got[3]
    assert [tuple(s) for s in got[None]] == [(0, 5, "email", True)]
    assert pii_spans(empty).count() == 0


def test_main_text(spark):
    shared = "<div>Read more on our site today</div>"
    page = lambda k, body: (k, f"http://h.example/{k}", f"<html><body>{shared}<nav>menu</nav>{body}</body></html>", "x")
    rows = [page(k, f"<div>Own   words &amp;\n{k}</div><p>second<br>line {k}<p>third {k}") for k in range(8)]
    rows += [(8, None, None, "x"), (9, "http://h.example/9", "", None), (10, "http://o.example", f"{shared}<p>alone</p>", "x")]
    got = {r["page_id"]: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[3]["text"] == "Own words & 3\nsecond line 3\nthird 3" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[8]["text"] == got[9]["text"] == "" and got[10]["text"] == "Read more on our site today\nalone"
    whole = Page("<article><h1>T</h1><p>a<!-- c --> b<aside>no</aside><div class='ad'>no</div></article><footer>no</footer><p>out")
    assert whole.text(set()) == "T\na b"
    assert Page("<p>cut &amp; <a href='x").text(set()) == "cut &"
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_pages_parse_in_linear_time():
    n = 100_000
    start = time.perf_counter()
    stray = Page("<div>" * n + "x" + "</section>" * n)
    nested = Page("<ul><li><ul>" + "<b>" * n + "<li>y</li>" * n)
    assert time.perf_counter() - start < 60  # a walk of the whole stack for each tag takes hours
    assert stray.text(set()) == "x" and nested.text(set()).count("y") == n


def test_end_tags_close_the_innermost_open_element():
    page = Page("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul><p>f<b>g<div>h</b>i</div></section>j")
    assert page.text(set()) == "a\nb\nc\nd\ne\nfg\nhi\nj"


def test_main_text_of_marked_wrappers_and_stray_articles():
    story = "A long story goes on and on. " * 20
    for names in ("page no-sidebar", "has-header", "two-side", "menu-fixed", "page header"):
        assert Page(f"<div class='{names}'><article>{story}</article></div>").text(set()) == story.strip(), names
    for wrapper in ("<div class=header>", "<div id=comments><div class=comment>", "<div class='ad'>"):
        assert Page(f"{wrapper}{story}</div></div>").text(set()) == story.strip(), wrapper
    posts = "".join(f"<div class=comment>post {k} {story}</div>" for k in range(9))
    assert Page(f"<p>Forum</p>{posts}").text(set()).count("post") == 9
    card = "<article><h3>More stories</h3></article>"
    assert Page(f"<div>{story}</div>{card}").text(set()) == f"{story.strip()}\nMore stories"
    assert Page(f"<div class=header>{story}</div>{card}").text(set()) == f"{story.strip()}\nMore stories"
    boxes = "<div class='box ad'>Buy</div><div class=cookie-banner>We use cookies</div><div id=sidebar>Tags</div><p>stray</p>"
    assert Page(f"{boxes}<article>{story}</article>").text(set()) == story.strip()
    assert Page("<div class=ad>An advert longer than the text.</div><article>Short.</article>").text(set()) == "Short."


def test_templates_of_large_hosts_and_of_both_places(spark):
    story = lambda k: f"<article><p>Story {k} is told here at some length, once and for all.</p>{{}}</article>"
    notice, box, quote = "<div>Section notice</div>", "<div>Read on</div>", "<p>A quotation</p>"

    def texts(n, outside, inside):
        rows = [(k, f"http://h.example/{k}", outside(k) + story(k).format(inside(k))) for k in range(n)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        return {r["page_id"]: r["text"] for r in main_text(pages.repartition(8)).collect()}

    # 120 of 3,000 pages (4 %) outside articles; 600 (20 %) inside; 400 with a box too few.
    few = "<ul><li>own list</li></ul>"
    body = lambda k: f"<div>Body {k} is told here.</div>" if k < 120 else ""
    rows = [(k, f"http://h.example/{k}", body(k) + (notice if k < 120 else story(k).format((box if k < 720 else "") + quote + (few if k < 520 else "")))) for k in range(3000)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)).collect()}
    assert got[5] == "Body 5 is told here."
    assert got[600].endswith("and for all.\nA quotation")
    assert got[200].endswith("A quotation\nown list")
    # 40 % of the host outside articles, one page inside: template there, text here.
    got = texts(50, lambda k: f"<p>intro {k} " + "x" * 90 + "</p>" + (notice if k < 20 else ""), lambda k: notice if k == 49 else "")
    assert not any("notice" in got[k] for k in range(20)) and got[49].endswith("Section notice")
    # A paragraph that is template outside is kept as an article's text block.
    got = texts(20, lambda k: quote if k < 10 else "", lambda k: quote if k == 15 else "")
    assert got[15].endswith("A quotation") and "quotation" not in got[3]


def test_mix(docs, empty):
    tokens = {"a": 100.0, "b": 10.0, "c": 1.0}
    e = find_exponent(tokens, 111.0, 2.0, None)
    w = weights({s: n / 111 for s, n in tokens.items()}, e)
    assert max(w[s] * 111 / n for s, n in tokens.items()) == pytest.approx(2.0, abs=1e-6)
    e = find_exponent(tokens, 111.0, None, 0.9)
    assert entropy(weights({s: n / 111 for s, n in tokens.items()}, e)) == pytest.approx(0.9, abs=1e-6)
    rows = mix(docs, block_rows=4).collect()
    total = {}
    for i, t, _, s, _ in documents():
        total[s] = total.get(s, 0) + len(WORD.findall(t or ""))
    spent = sum(total.values())
    for s, n in total.items():
        own = [r for r in rows if r["source"] == s]
        got, weight = sum(r["n_tokens"] for r in own), own[0]["weight"]
        assert weight * spent <= got + 1e-6 and got < weight * spent + max(r["n_tokens"] for r in own) + 1
        assert weight * spent <= 1.25 * n * (1 + 1e-9) or len(total) == 1
    assert mix(empty).count() == 0


def test_exponent_meets_its_target_or_raises():
    tokens = {"a": 100, "b": 10, "c": 1, "none": 0}
    shares = {s: n / 111 for s, n in tokens.items()}
    for target in (0.9, 0.1, 1e-4):  # the shares have 0.353
        assert entropy(weights(shares, find_exponent(tokens, 111.0, None, target))) == pytest.approx(target, abs=1e-6)
    for budget, repetition, target in ((300.0, 2.0, None), (111.0, None, 1.2), (111.0, None, -0.1)):
        with pytest.raises(ValueError):
            find_exponent(tokens, budget, repetition, target)
    with pytest.raises(ValueError):
        find_exponent({"a": 5, "b": 5}, 10.0, None, 0.3)
    assert find_exponent(tokens, 222.0, 2.0, None) == pytest.approx(1.0)
    assert find_exponent({}, 0.0, 1.25, None) == 0.0


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randint(0, 14))]

        def brute(a, b):
            spans = [(sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            if not spans or max(spans)[0] <= 0:
                return []
            top = max(x[0] for x in spans)
            i, j = next((x[3], x[4]) for x in sorted(spans, key=lambda x: (x[4] - x[3], x[3])) if x[0] == top)
            return brute(a, i) + [(i, j, top)] + brute(j, b)

        assert sum(x[2] for x in maximal_segments(np.array(s, float))) == sum(x[2] for x in brute(0, len(s)))


def test_classifiers(spark, docs, empty):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["calm", "river", "stone", "walks"]) for _ in range(30)) + "." for _ in range(200)]
    bad = [" ".join(rng.choice(["CALM!!", "RIVER!!", "idiot", "moron"]) for _ in range(30)) for _ in range(60)]
    texts = [*good, *bad, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i < 200), int(i >= 200)) for i in range(0, 260) if i % 2] + [(None, 1, 1), (3, None, None)],
        "doc_id long, quality int, toxic int",
    )
    quality = {r["doc_id"]: r for r in quality_scores(df, labels).collect()}
    toxic = {r["doc_id"]: r for r in toxic_scores(df, labels).collect()}
    for i in range(260):
        assert toxic[i]["predicted"] == (i >= 200), i
        assert quality[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert min(quality[i]["score"] for i in range(200)) > max(quality[i]["score"] for i in range(200, 260))
    assert all(quality[i]["predicted"] for i in range(200))
    assert toxic[230]["passages"] and not toxic[261]["passages"] and 0 <= quality[260]["score"] <= 1
    assert keep_good(df, labels).count() >= 200
    assert quality_scores(empty, labels).count() == 0 and toxic_scores(empty, labels.where("false")).count() == 0
    assert docs.select(fold().alias("f")).where("f is null").count() == 0


def test_bpe(spark, docs, empty):
    tokenizers, vocabulary = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    from baroflow.llm.bpe import bpe

    path = vocabulary.path("byte_bpe_50k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    rows = {r["doc_id"]: r for r in bpe(docs, path).collect()}
    for i, t, *_ in documents():
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(rows[i]["token_ids"], "<u4").tolist() == ids and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["decoded"] == reference.decode(ids, skip_special_tokens=False)
    assert bpe(empty, path).count() == 0


def test_toxic_log_odds_against_plain_counts(spark):
    """Odds of either sign; only rare and unseen words take those of a prefix."""
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        text = "plain common words here" + (" scumbag" if toxic and i % 8 == 0 else "") + (" scumble" if not toxic and i % 3 == 0 else "")
        rows.append((i, f"{text} filler{'abcdefghij'[i % 10]} {'pretty' if not toxic else ''} n{i}", int(toxic)))
    frame = spark.createDataFrame(rows, "id long, text string, toxic int")
    model = toxicity.fit(frame.select("id", "text"), frame.select("id", "toxic"), "toxic", 0, 3.5, 1000, 1000)
    train = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    size = Counter(y for _, y in train)
    share = size[1] / len(train)

    def plain(holds):
        n = Counter(y for t, y in train if any(holds(w) for w in re.findall("[a-z]+", t)))
        every = n[0] + n[1]
        if every < 8:
            return None
        a = {1: every * share * 0.1, 0: every * (1 - share) * 0.1}
        odds = [math.log((n[y] + a[y]) / (size[y] + 1 + a[y] - n[y])) for y in (0, 1)]
        odds, error = odds[1] - odds[0], math.sqrt(sum(1 / (n[y] + a[y]) for y in (0, 1)))
        return math.copysign(max(abs(odds) - 2 * error, 0), odds) if abs(odds) >= 3.5 * error else 0.0

    for word in ("scumbag", "scumble", "pretty", "plain", "scumbags", "scumbl", "scumxyz", "scum", "prettier", "unseen"):
        want = plain(lambda w: w == word)
        for k in (6, 5, 4):
            if want is None:
                want = plain(lambda w: w.encode()[:k] == word.encode()[:k])
        (chunk,) = chunks(pa.array([word]))
        got = toxicity.token_scores(model, toxicity.tokens(chunk)[3])
        assert got[0] == pytest.approx((want or 0.0) + toxicity.DRIFT, abs=1e-9), word
    assert plain(lambda w: w == "scumbag") > 1 > -1 > plain(lambda w: w == "pretty")
