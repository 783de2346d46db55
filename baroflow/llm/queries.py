"""One query per operator of this subpackage, over whole tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baroflow.llm.bpe import bpe
from baroflow.llm.common import fold
from baroflow.llm.contamination import contamination
from baroflow.llm.exact import exact_dedup
from baroflow.llm.jaccard import jaccard_components
from baroflow.llm.lexical import ranked_search
from baroflow.llm.lm import lm_scores
from baroflow.llm.mixing import mix
from baroflow.llm.pii import BASE, pii_spans
from baroflow.llm.quality import quality_scores
from baroflow.llm.spelling import spelling_groups
from baroflow.llm.templates import main_text
from baroflow.llm.topk import top_k
from baroflow.llm.toxicity import toxic_scores

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """Path of the published vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_main_text(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", "n_chars")


@query
def op2_temperature_mix(spark, sf):
    return mix(table(spark, sf, "documents")).select(
        "doc_id", "source", "epoch", F.col("block_order").cast("long").alias("block_order"), "n_tokens", "weight"
    )


@query
def op3_personal_data(spark, sf):
    found = pii_spans(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


@query
def op4_jaccard_join(spark, sf):
    return jaccard_components(table(spark, sf, "documents"))


@query
def op5_quality_scores(spark, sf):
    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op6_bpe_codec(spark, sf):
    coded = bpe(table(spark, sf, "documents").select("doc_id", "text"), vocabulary_path())
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op7_toxic_segments(spark, sf):
    return toxic_scores(table(spark, sf, "documents"), table(spark, sf, "labels")).select(
        "doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages")
    )


@query
def op8_exact_dedup(spark, sf):
    return exact_dedup(table(spark, sf, "documents"))


@query
def op9_exact_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@query
def op10_lm_scores(spark, sf):
    return lm_scores(table(spark, sf, "documents"))


@query
def op11_benchmark_passages(spark, sf):
    found = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query
def op12_spelling_variants(spark, sf):
    return spelling_groups(table(spark, sf, "documents"))


@query
def op13_ranked_search(spark, sf):
    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLES["op4_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT a AS doc_id, a AS r FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) m USING (doc_id)
"""

ORACLES["op8_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

ORACLES["op9_exact_topk"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
"""

ORACLES["op11_benchmark_passages"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS size, ws[i:i + least(10, len(ws)) - 1] AS words
  FROM b, LATERAL (SELECT unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM win),
cut AS (
  SELECT r, i, size, ws[i:i + size - 1] AS words
  FROM (SELECT r, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
hit AS (SELECT r, i, size, item_id FROM cut JOIN win USING (size, words)),
covered AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN held USING (r)
"""

ORACLES["op12_spelling_variants"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS s(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY 1, 2),
bytes AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM each),
crc AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(0, length(h) // 2), lambda i:
      ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
  FROM bytes, crc_table),
seen AS (
  SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, n FROM crc),
w AS (SELECT word, sum(n)::BIGINT AS n FROM seen WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
keyed AS (SELECT word, n, substr(word, 1, (i - 1)::INT) AS a, substr(word, (i + 1)::INT) AS b FROM cuts),
pairs AS (
  SELECT x.word, y.word AS other, y.n FROM keyed x JOIN keyed y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT k.word, w.word, w.n FROM keyed k JOIN w ON w.word = k.a || k.b
  UNION SELECT w.word, k.word, k.n FROM keyed k JOIN w ON w.word = k.a || k.b),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, b.other AS form, b.other_n AS form_n FROM w JOIN best b USING (word) WHERE b.other_n >= 10 * w.n),
ways AS (
  SELECT word, word AS root FROM w UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON forms.word = ways.root),
roots AS (SELECT word, root FROM ways WHERE root NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, r.root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
FROM w JOIN roots r USING (word) LEFT JOIN forms f USING (word) LEFT JOIN best b USING (word)
"""

ORACLES["op13_ranked_search"] = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN len USING (doc_id), total GROUP BY 1, 2),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
