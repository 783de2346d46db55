"""Inputs that once crashed or stalled an operator."""

import random
import re
import time

import pyarrow as pa

from baroflow.llm.mixing import mix
from baroflow.llm.pii import base_spans, candidates, luhn
from baroflow.llm.quality import N_FEATURES, SLICE_ROWS, features

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out)


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(3)
    pieces = ["a@b.co", "@", "@@", ".", "-", " ", "+", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "007.08.9.10", "+49 (30) 1234-5678", "x", "é", "_%", "12"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert sorted(base_spans(text)) == plain_spans(text), text


def test_numbers_longer_than_python_reads():
    zeros, ones = "0" * 5000 + ".1.1.1", "1" * 5000 + ".1.1.1"
    assert base_spans(zeros) == [(0, 5006, "ip")]
    assert base_spans(ones) == []


def test_many_candidates_take_linear_time():
    text = "555-123-4567 " * 20000
    began = time.time()
    assert len(candidates(text)) == 20000
    assert time.time() - began < 5


def test_candidates_overlap_no_other_span():
    rng = random.Random(8)
    pieces = ["a@b.co ", "4111-1111-1111-1111", " 555-123-4567", " 123-45-6789 ", " DE89 3704 0044 0532 0130 00", " x (at) y (dot) com", "+1 555 123 4567 ", "."]
    for _ in range(300):
        found = candidates("".join(rng.choice(pieces) for _ in range(12)))
        added = sorted((a, b) for a, b, _, base in found if not base)
        assert all(b <= c for (_, b), (c, _) in zip(added, added[1:]))
        base = [(a, b) for a, b, _, is_base in found if is_base]
        assert not any(a < d and c < b for a, b in added for c, d in base)


def test_short_texts_come_in_slices():
    texts = pa.array(["a b", None, ""] * 4000)
    sizes = [len(x) for _, x in features(texts)]
    assert sum(sizes) == 12000 and max(sizes) <= SLICE_ROWS
    whole = next(features(pa.array(["a b", "C d 1"])))[1]
    assert whole.shape == (2, N_FEATURES)


def test_mix_with_clashing_columns(spark):
    names = "doc_id long, text string, source string, BLOCK_order long, whole int, cut long, s string, block long, weight double, n_tokens int"
    rows = [(i, "w " * (i % 7), "ab"[i % 2], 5, 6, 7, "q", 8, 0.5, 1) for i in range(60)]
    docs = spark.createDataFrame(rows, names)
    plain = mix(docs.select("doc_id", "text", "source"))
    got = mix(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and "_block_order" in got.columns
    assert sorted((r["doc_id"], r["epoch"], r["_block_order"]) for r in got.collect()) == sorted(
        (r["doc_id"], r["epoch"], r["block_order"]) for r in plain.collect()
    )
    assert all((r["BLOCK_order"], r["whole"], r["cut"], r["s"]) == (5, 6, 7, "q") for r in got.collect())


def test_mix_starts_no_python_workers(spark, tmp_path):
    rows = [(i, "w " * (i % 7), "ab"[i % 2] if i % 5 else None) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/docs")
    mixed = mix(spark.read.parquet(f"{tmp_path}/docs"))
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "Python" not in plan and "Arrow" not in plan
    assert {r["source"] for r in mixed.collect()} == {"a", "b", None}
