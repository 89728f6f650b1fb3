"""The registered queries ``op1_`` to ``op13_`` and ``pipeline``, and the SQL for those that have one."""

from __future__ import annotations

import hashlib
import os
import secrets
import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkeda.llm import (alignment, chat, graphs, licences, mixing, passages, pieces, quality, resampling, search, simhash, surrogates,
                          tokenfiles)
from sparkeda.llm.common import new_path, table, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Where the tokenizer files are; the default is the installed package's folder.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "")
#: The key of the surrogates; outside a local session a deployment sets its own.
PII_KEY = os.environ.get("PII_KEY", "sparkeda-demo-key").encode()


def pii_key(spark: SparkSession) -> bytes:
    """The key in ``PII_KEY`` of the environment.  Only a local session, as in tests, may go without; the key that
    it then uses is public."""
    if not os.environ.get("PII_KEY") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set PII_KEY: with a public key anyone can draw the surrogates again")
    given = os.environ.get("PII_KEY", "").encode() or PII_KEY
    return given if len(given) <= hashlib.blake2b.MAX_KEY_SIZE else hashlib.blake2b(given).digest()


_DRAWN: dict[str, bytes] = {}


def run_key(spark: SparkSession) -> bytes:
    """``pii_key``; a cluster without one gets a key drawn at random for the application, which only the driver's memory and its
    tasks hold.  Then nobody can draw the surrogates again, and equal entities agree in all queries of the application, but
    not with those of another one."""
    try:
        return pii_key(spark)
    except ValueError:
        app = spark.sparkContext.applicationId
        if app not in _DRAWN:
            warnings.warn("PII_KEY is not set: surrogates are drawn with a random key and agree inside this application only")
            _DRAWN[app] = secrets.token_bytes(32)
        return _DRAWN[app]


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_topk_maxscore", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256.0 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.x, d.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.search(e, e.where("vec_id % 50 = 0"), k=5)


@register("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return tokenfiles.with_crc32(tokenfiles.read_token_files(spark, path))


@register("op3_pii_surrogates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(d, run_key(spark), count_col="n_entities")


@register("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


@register("op5_simhash_anchors")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return d.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op6_repeated_passages")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@register("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents, written, and what decoding the written ids gives, against the text they came from."""
    model = tokenizer_path("piece_bpe_32k.model")
    d = table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "text")
    ids = written(pieces.encode(d, model, keep=["doc_id", "text_crc32"]), "pieces")
    back = pieces.decode(ids, model, keep_ids=True)
    return back.select("doc_id", "n_tokens", "token_ids", (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("round_trip"))


@register("op9_chat_formatting")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], c.schema)
    return chat.digest_chats(written(chat.format_chats(c.unionByName(more)), "chats"))


def _licence_sql() -> str:
    """Units and passages over the same fixed templates and anchors, written for a relational engine."""
    rows = [(k, n, g) for k, n, g in licences.template_rows() if g]
    values = ", ".join("('{}', {}, {}, [{}])".format(k, no, len(licences.normal_words(licences.TEMPLATES[k][n])), ", ".join(f"'{x}'" for x in g))
                       for no, (k, n, g) in enumerate(rows))
    anchors = ", ".join(f"('{g}', {no}, {p})" for g, no, p in licences.anchor_bigrams())
    return rf"""
WITH t(licence, part, n, b) AS (VALUES {values}),
a(gram, part, place) AS (VALUES {anchors}),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
      FROM documents WHERE text IS NOT NULL),
l AS (SELECT rid, doc_id, 'line' AS unit, unnest(string_split(x, chr(10))) AS body, unnest(range(len(string_split(x, chr(10))))) AS unit_no FROM d),
bl AS (SELECT rid, doc_id, x, regexp_split_to_array(x, '\n[ \t\r]*\n') AS parts FROM d),
b AS (SELECT rid, doc_id, 'block' AS unit, unnest(parts) AS body, unnest(range(len(parts))) AS unit_no FROM bl),
u AS (SELECT rid, doc_id, unit, unit_no, body FROM l
      UNION ALL SELECT rid, doc_id, unit, unit_no, body FROM b WHERE contains(body, chr(10))
      UNION ALL SELECT rid, doc_id, 'text', 0, x FROM bl WHERE len(parts) > 1
      UNION ALL SELECT rid, doc_id, 'passage', 0, x FROM bl),
w AS (SELECT rid, doc_id, unit, unit_no, list_filter(list_transform(regexp_split_to_array(body, '[^a-z0-9.]+'), lambda y: trim(y, '.')), lambda y: y <> '') AS w FROM u),
g AS (SELECT rid, doc_id, unit, unit_no, len(w) AS n_words, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM w WHERE len(w) > 1),
gd AS (SELECT rid, doc_id, unit, unit_no, n_words, list_distinct(g) AS g FROM g WHERE unit <> 'passage'),
c AS (SELECT rid, doc_id, unit, unit_no, n_words, licence, 2.0 * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM gd, t
      WHERE len(g) BETWEEN 0.66 * len(b) AND 1.51 * len(b)),
h AS (SELECT rid, unnest(g) AS gram, unnest(range(len(g))) AS i FROM g WHERE unit = 'passage'),
s AS (SELECT DISTINCT rid, part, i - place AS start FROM h JOIN a USING (gram)),
win AS (SELECT s.rid, g.doc_id, t.licence, greatest(s.start, 0) AS lo, least(s.start + t.n, g.n_words) AS hi, t.b, g.g
        FROM s JOIN t USING (part) JOIN g ON g.rid = s.rid AND g.unit = 'passage'),
wg AS (SELECT rid, doc_id, licence, lo, hi, b, list_distinct(list_slice(g, lo + 1, hi - 1)) AS g FROM win),
wd AS (SELECT rid, doc_id, licence, lo, hi, 2.0 * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM wg
       WHERE len(g) BETWEEN 0.66 * len(b) AND 1.51 * len(b)),
o AS (SELECT *, max(hi) OVER (PARTITION BY rid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM wd WHERE dice >= 0.8),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR lo >= before THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM o),
p AS (SELECT *, min(lo) OVER (PARTITION BY rid, run) AS unit_no, max(hi) OVER (PARTITION BY rid, run) - min(lo) OVER (PARTITION BY rid, run) AS n_words FROM r),
f AS (SELECT rid, doc_id, unit, unit_no, n_words, licence, max(CAST(dice AS DOUBLE)) AS dice FROM c WHERE dice >= 0.8 GROUP BY ALL
      UNION ALL SELECT rid, doc_id, 'passage', unit_no, n_words, licence, max(CAST(dice AS DOUBLE)) FROM p GROUP BY ALL)
SELECT doc_id, unit, CAST(unit_no AS INTEGER) AS unit_no, CAST(n_words AS INTEGER) AS n_words, licence, dice,
       dice = max(dice) OVER (PARTITION BY rid, unit, unit_no) AS best FROM f"""


@register("op10_licence_dice", _licence_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@register("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@register("op12_nearest_graph")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return graphs.search(e, e.where("vec_id % 20 = 0"), k=20)


@register("op13_importance_resampling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def load_all() -> tuple[dict, dict]:
    """The registered queries and their SQL."""
    import corpus_pipeline

    sql = dict(ORACLE)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return dict(QUERIES), sql
