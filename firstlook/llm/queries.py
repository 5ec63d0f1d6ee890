"""One query for each operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import learning
from .backoff_lm import lm_scores
from .divergence_rules import quality_rules
from .jaccard_join import jaccard_components
from .line_dedup import keep_bitmaps, kept_text
from .packing import pack_documents
from .pii import KINDS, fit_tagger, pii_spans
from .periodic_runs import periodic_runs, strongest, with_repeated_tails
from .piece_tokens import piece_counts
from .prefix_trie import prefix_trie
from .quality_classifier import QualityModel, fit_quality, score_quality
from .suffix_dedup import without_repeats
from .topk import exact_top_k, whole_weights
from .toxicity import fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), whole_weights(F.col("embedding"), 256).alias("weights"))
    return exact_top_k(vectors.filter("id % 50 = 0"), vectors, 5)


TOPK_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_table(spark, sf_dir, "documents"), 50).select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


REPEATS_SQL = """
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), placed AS (
    SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM texts WHERE n >= 50
), strings AS (
    SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM placed
), firsts AS (
    SELECT s, min(doc_id) AS first_id FROM strings GROUP BY s
), hits AS (
    SELECT doc_id, p, p > lag(p, 1, -100) OVER (PARTITION BY doc_id ORDER BY p) + 50 AS opens
    FROM strings JOIN firsts USING (s) WHERE first_id < doc_id
), runs AS (
    SELECT doc_id, min(p) AS a, max(p) + 50 AS b
    FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits) GROUP BY doc_id, run
), gaps AS (
    SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs
), cut AS (
    SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
        string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
    FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""


def op2_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"), learning.held_out(F.col("doc_id"), 7, 2))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The same vocabulary and ids as byte_bpe_50k.json, read by the faster of its two libraries.
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def quality_model(spark: SparkSession, sf_dir: str) -> QualityModel:
    """Trained on rows marked good outside the held-out fold, and rows of the same folds without any mark there; held-out rows have no part in it."""
    fitting = F.col("doc_id").isNotNull() & ~learning.held_out(F.col("doc_id"), 3, 1)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = learning.labels_by_id(_table(spark, sf_dir, "labels").filter(fitting), "quality")
    trusted = labels.filter(F.col("label") == 1)
    unlabelled = docs.select("doc_id").filter(fitting).join(labels.select("doc_id"), "doc_id", "left_anti")
    return fit_quality(docs, trusted, unlabelled)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    return scores.select(
        "doc_id", learning.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_spans(docs, fit_tagger(docs))
    rules = F.filter("spans", lambda s: s["by_rule"])
    kinds = F.array(*[F.lit(k) for k in KINDS])
    # A function of two parameters would be given places in the array for the second one.
    of_kind = lambda k: F.filter(rules, lambda s: s["kind"] == k)
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])))
    return found.select(
        "doc_id", *[F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed(rules), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


NEAR_COPIES_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), placed AS (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM placed
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
    SELECT doc_id AS id, doc_id AS r FROM sizes
    UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r
), least AS (
    SELECT id, min(r) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON least.id = d.doc_id
"""


def op8_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = learning.labels_by_id(_table(spark, sf_dir, "labels"), "toxic").filter(~learning.held_out(F.col("doc_id"), 4, 2))
    scores = score_toxicity(docs, fit_toxicity(docs, labels))
    return scores.select(
        "doc_id", learning.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_sentences", "worst_start", "worst_end", "worst_score",
    )


def first_turns_shared(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % 9


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.col("conv_id") - F.col("conv_id") % 5
    return prefix_trie(_table(spark, sf_dir, "conversations"), group, first_turns_shared)


PREFIXES_SQL = """
WITH own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
        md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS bytes
    FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
    SELECT DISTINCT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
        lambda d: list_transform(range(8), lambda b: (ascii(d) >> CAST(b AS INTEGER)) & 1))) AS bits
    FROM own
), heads AS (
    SELECT conv_id, conv_id - conv_id % 5 AS head, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bits, lambda b: b::BIGINT)),
        lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) % 9 AS h
    FROM bits
), rebuilt AS (
    SELECT heads.conv_id, 0 AS part, place, id, bytes FROM heads JOIN own ON own.conv_id = head WHERE place <= h
    UNION ALL SELECT conv_id, 1, place, id, bytes FROM heads JOIN own USING (conv_id) WHERE place > h
), steps AS (
    SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(id, '') OVER w) AS node, bytes
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT conv_id, 0, '', 0 FROM heads
), linked AS (
    SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) AS below FROM steps
), nodes AS (
    SELECT node, any_value(above) AS above, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(bytes) AS bytes, count(*) AS n_convs,
        count(DISTINCT below) AS n_children, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (below IS NULL), '') AS ends
    FROM linked GROUP BY node
), sums AS (
    SELECT u.node, count(*) FILTER (v.n_children = 0) AS n_leaves, CAST(sum((v.n_convs - 1) * v.bytes) AS BIGINT) AS saved_tokens
    FROM steps u JOIN nodes v ON v.conv_id = u.conv_id AND v.depth >= u.depth GROUP BY u.node
)
SELECT nodes.conv_id, nodes.depth, up.conv_id AS parent_conv_id, nodes.n_convs, nodes.n_children, n_leaves, saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN sums USING (node) LEFT JOIN nodes up ON up.node = nodes.above
"""


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("rest.text", F.lit(""))
    kept = F.when(F.col("n_dropped") == 0, text).otherwise(kept_text(text, F.col("keep")))
    return keep_bitmaps(_table(spark, sf_dir, "documents").select("doc_id", "text"), 40, 5, rest=True).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256")
    )


LINES_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT doc_id, place, line, coalesce(doc_id < top, false) AS gone FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def repeats_of_words(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs).withColumn("best", strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") == 0, "").otherwise(F.concat(listed, F.lit("\n"))), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"), "n_words",
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_of_words(with_repeated_tails(_table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    "op1_suffix_dedup": (op1_suffix_dedup, REPEATS_SQL),
    "op2_backoff_lm": (op2_backoff_lm, None),
    "op3_exact_topk": (op3_exact_topk, TOPK_SQL),
    "op4_best_fit_packing": (op4_best_fit_packing, None),
    "op5_quality_classifier": (op5_quality_classifier, None),
    "op6_pii": (op6_pii, None),
    "op7_jaccard_join": (op7_jaccard_join, NEAR_COPIES_SQL),
    "op8_piece_tokens": (op8_piece_tokens, None),
    "op9_divergence_rules": (op9_divergence_rules, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_prefix_trie": (op11_prefix_trie, PREFIXES_SQL),
    "op12_line_dedup": (op12_line_dedup, LINES_SQL),
    "op13_periodic_runs": (op13_periodic_runs, None),
}
