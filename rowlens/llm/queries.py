"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_back
from .common import Scratch, table
from .embedding_dedup import embedding_dedup
from .exact_dedup import dedup_exact
from .language_model import score_texts
from .mixing import mix
from .near_dedup import near_dedup
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .substring_dedup import substring_dedup
from .url_filter import filter_urls


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(extra)))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as s:
        return s.keep(score_texts(table(spark, sf_dir, "documents"), s))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as s:
        return s.keep(filter_urls(table(spark, sf_dir, "pages"), s))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as s:
        return s.keep(embedding_dedup(table(spark, sf_dir, "embeddings"), s))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as s:
        return s.keep(substring_dedup(table(spark, sf_dir, "documents"), s))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as s:
        return s.keep(mix(table(spark, sf_dir, "documents"), s).select("doc_id", "size", "source_size", "target", "taken", "copies"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as s:
        return s.keep(dedup_exact(table(spark, sf_dir, "documents"), s))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as s:
        return s.keep(near_dedup(table(spark, sf_dir, "documents"), s, size=2))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_lm_score, op3_url_filter, op4_quality, op5_embedding_dedup, op6_suffix_dedup, op7_mix_sources, op8_exact_dedup, op9_minhash_dedup, op10_pack)}

ORACLE_SQL = {
    "op1_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, length('<|turn|><|text|><|end|>') + 1 + length(role) + length(text)
                + len(regexp_extract_all(text, '<\\*(\|turn\||\|text\||\|end\||\|im_start\||\|im_end\||\|endoftext\||s|/s)>|\[\\*/?INST\]'))
                + len(regexp_extract_all(role, '<\\*(\|turn\||\|text\||\|end\||\|im_start\||\|im_end\||\|endoftext\||s|/s)>|\[\\*/?INST\]')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
""",
    "op5_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.node = v.vec_id
""",
    "op9_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT m.b, reach.root FROM reach JOIN m ON m.a = reach.node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON c.node = n.doc_id
""",
    "op6_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS i FROM d)),
p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM p),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, g),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM r GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM r UNION ALL SELECT doc_id, coalesce(last, 0), length(h) // 2 FROM d LEFT JOIN n USING (doc_id)),
t AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id) AS kept,
       sha256(body) AS text_sha256
FROM d
""",
}
