"""The pipeline's stages, each on what its predecessor kept, next to plain Python."""

import hashlib
import struct

import corpus_pipeline as pipeline
from baroflow.llm.queries import vocabulary_path
from baroflow.llm.quality import quality_scores
from tests.llm.test_llm import DOCS, documents, shingle_set


def test_stages_and_whole_run(spark, tmp_path):
    rows = documents(40, 11)
    rows += [(500 + i, t, *rest) for i, (_, t, *rest) in enumerate(rows[:12])] + [(None, "a row without an id", "en", "a", None)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(pipeline.STAGES)

    good = stages["quality classifier"](spark, docs, str(tmp_path))
    rejected = {r["doc_id"] for r in quality_scores(docs, labels).where("predicted = 0").collect()} - {None}
    kept = [r for r in rows if r[0] not in rejected]
    assert good.columns == docs.columns and sorted(map(tuple, good.collect()), key=str) == sorted(kept, key=str)

    groups = {}
    for r in kept:
        groups.setdefault("".join(c for c in r[1] or "" if c not in " \t\n\v\f\r"), []).append(r)
    best = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    unique = stages["exact dedup"](spark, good, str(tmp_path))
    assert sorted(map(tuple, unique.collect()), key=str) == sorted(best, key=str)

    component = {r[0]: r[0] for r in best if r[0] is not None}
    sets = {r[0]: shingle_set(r[1]) for r in best if r[0] is not None}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                linked = sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
                if linked and component[b] < component[a]:
                    component[a], changed = component[b], True
    alone = [r for r in best if r[0] is None or component[r[0]] == r[0]]
    single = stages["n-gram Jaccard join"](spark, unique, str(tmp_path))
    assert sorted(map(tuple, single.collect()), key=str) == sorted(alone, key=str)

    mixed = stages["mixing sources to target weights"](spark, single, str(tmp_path))
    known = {r[0] for r in alone}
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= known

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    coded = stages["BPE encoding and decoding"](spark, single, str(tmp_path)).collect()
    texts = {r[0]: r[1] or "" for r in alone}
    assert len(coded) == len(alone)
    for r in coded:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r["token_ids"]) == packed and r["ids_sha256"] == hashlib.sha256(packed).hexdigest() and r["round_trip"]

    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in whole} <= known and all(r["round_trip"] for r in whole)
