"""Registered queries: embedding inputs, vectors, nearest cards, contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesteward.functions import text, vectors
from tablesteward.operators import embedding, hyperplanes, retrieval
from tablesteward.operators.cards import collect_cards
from tablesteward.session import materialize, scratch_path, spread
from tablesteward.workload.catalog import CARD_TEXTS
from tablesteward.workload.inputs import table, table_refs, text_literal

WIDTH = 1536
MAX_DISTANCE = 0.55


def embed_input(spark, sf_dir):
    prepared = table(spark, sf_dir, "documents").select(
        "doc_id", "text", vectors.embed_input(F.col("text"), vectors.DOCUMENT_INSTRUCTION).alias("input")
    )
    instruction_chars = len(vectors.DOCUMENT_INSTRUCTION)
    return prepared.select(
        "doc_id",
        F.length("input").cast("bigint").alias("input_chars"),
        (F.length("text") + instruction_chars > vectors.INPUT_CHARS).alias("truncated"),
        F.sha2("input", 256).alias("digest"),
    )


def embed_hash_tf(spark, sf_dir):
    """Non-zero weights of each document's vector."""
    embedded = vectors.embed_column(
        spread(table(spark, sf_dir, "documents")), "text", "vector", vectors.hashed_term_embedder(), vectors.DOCUMENT_INSTRUCTION
    )
    weights = embedded.select("doc_id", F.posexplode("vector").alias("bucket", "weight")).where("weight != 0")
    return weights.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def unsteady_embedder(dimensions):
    """The hashed-term embedder as a service that refuses every request with a text of some lengths in it."""
    steady = vectors.hashed_term_embedder(dimensions)

    def embed(texts):
        if any(len(text) % 10 == 3 for text in texts):
            raise ConnectionError("refused")
        return steady(texts)

    embed.input_chars = None
    return embed


def embed_requests(spark, sf_dir):
    """Documents embedded by requests: which failed, and how many weights the others have."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = embedding.embed_with_requests(docs, "text", "vector", unsteady_embedder(256), vectors.DOCUMENT_INSTRUCTION, 256, tries=1)
    weights = F.size(F.filter("vector", lambda x: x != 0)).cast("bigint")
    return made.select("doc_id", F.col("embed_error").alias("error"), F.coalesce(F.when(F.col("vector").isNotNull(), weights), F.lit(0)).alias("weights"))


def vector_dim_check(spark, sf_dir):
    """Vectors cut or emptied by their label, checked for 64 values."""
    cut = F.when(F.col("label") == 9, F.lit(None)).otherwise(F.slice("embedding", F.lit(1), F.lit(60) + F.col("label")))
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.vector_status(cut, 64).alias("status"))


def l2_normalize(spark, sf_dir):
    """Vectors scaled by their label (label 0 gives zero vectors), made unit again."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    unit = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("scaled")).select(
        "vec_id", F.posexplode(vectors.l2_normalize(F.col("scaled"))).alias("position", "value")
    )
    return unit.select("vec_id", "position", F.round(F.col("value"), 6).alias("value"))


def _neighbours(spark, sf_dir, max_distance=None):
    stored = table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("vector"))
    return retrieval.nearest(
        stored.withColumnRenamed("vec_id", "q_id"),
        stored.withColumnRenamed("vec_id", "doc_id"),
        max_distance=max_distance,
        exclude_self=True,
    )


def knn_cosine(spark, sf_dir):
    return _neighbours(spark, sf_dir)


def knn_cosine_threshold(spark, sf_dir):
    return _neighbours(spark, sf_dir, MAX_DISTANCE)


def _approximate(spark, sf_dir):
    """Stored unit vectors, their codes kept beside them, and every vector's neighbours found by these."""
    stored = table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("vector"))
    stored = materialize(stored, "unit-vectors")
    index = stored.withColumnRenamed("vec_id", "doc_id")
    codes = hyperplanes.CodeTable(spark, scratch_path(spark, "codes"), hyperplanes.Hyperplanes(64))
    codes.refresh(index)
    settings = hyperplanes.calibrated(index, codes.settings)
    asked = stored.withColumnRenamed("vec_id", "q_id")
    return hyperplanes.nearest_approximate(asked, index, codes.read(), settings, exclude_self=True)


def knn_approximate(spark, sf_dir):
    return _approximate(spark, sf_dir)


def knn_recall(spark, sf_dir):
    """How many exact neighbours there are, and whether nine tenths of them are found approximately."""
    exact = _neighbours(spark, sf_dir).select("q_id", "doc_id")
    found = _approximate(spark, sf_dir).select("q_id", "doc_id", F.lit(1).alias("met"))
    return exact.join(found, ["q_id", "doc_id"], "left").agg(
        F.count(F.lit(1)).alias("neighbours"), (F.count("met") >= 0.9 * F.count(F.lit(1))).alias("recalled")
    )


def context_block(spark, sf_dir):
    """Contexts of the neighbours; vectors of label 0 have no card."""
    card = F.when(F.col("label") == 0, F.lit("")).otherwise(
        F.concat(F.lit("card "), F.col("vec_id").cast("string"), F.lit("\nlabel "), F.col("label").cast("string"))
    )
    cards = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), card.alias("card"))
    return retrieval.context_blocks(_neighbours(spark, sf_dir), cards)


def _questions(spark, sf_dir):
    asked = text.question_text(F.split("text", "\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", asked.alias("question"))


def question_text(spark, sf_dir):
    return _questions(spark, sf_dir).drop("role")


def retrieve_distinct(spark, sf_dir):
    """The context of every user turn: the closest schema cards of the given tables."""
    embedder = vectors.hashed_term_embedder(WIDTH)
    cards = collect_cards(spark, table_refs(sf_dir))
    index = materialize(
        vectors.embed_column(cards, "embed_text", "embedding", embedder, vectors.DOCUMENT_INSTRUCTION, WIDTH), "index"
    )
    asked = _questions(spark, sf_dir).where("role = 'user'").drop("role")
    found = retrieval.retrieve_contexts(asked, index, embedder, dimensions=WIDTH)
    return found.select("conv_id", "turn", F.length("context").cast("bigint").alias("context_chars"), F.sha2("context", 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        embed_input, embed_hash_tf, embed_requests, vector_dim_check, l2_normalize, knn_cosine, knn_cosine_threshold, knn_approximate, knn_recall,
        context_block, question_text, retrieve_distinct,
    )
}


_DOCUMENT, _QUERY = text_literal(vectors.DOCUMENT_INSTRUCTION), text_literal(vectors.QUERY_INSTRUCTION)


def _weights_sql(source: str, key: str, column: str, instruction: str) -> str:
    """``key, bucket, weight`` of a text column by the hashed-term rule."""
    return f"""(
  SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM (
    SELECT {key}, CAST('0x' || substr(md5(lower(word)), 1, 8) AS BIGINT) % {WIDTH} AS bucket, CAST(count(*) AS DOUBLE) AS n
    FROM (SELECT {key}, unnest(regexp_extract_all({instruction} || {column}, '[A-Za-z0-9]+')) AS word
          FROM {source}) GROUP BY 1, 2))"""


_KNN = """unit AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
pairs AS (
  SELECT q.vec_id AS q_id, d.vec_id AS doc_id, d.label, round(1 - list_cosine_similarity(q.v, d.v), 6) AS distance
  FROM unit q JOIN unit d ON q.vec_id <> d.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, doc_id) AS place FROM pairs)"""

_HEADER = text_literal(retrieval.CONTEXT_HEADER)
_RULE = text_literal(retrieval.CARD_RULE)
_ASKED = r"""asked AS (
  SELECT conv_id, turn, role, coalesce(regexp_replace(array_to_string(
    list_filter(string_split(text, chr(10)), lambda t: t <> ''), chr(10)), '^\s+|\s+$', '', 'g'), '') AS question
  FROM conversations)"""

ORACLE = {
    "embed_input": f"""SELECT doc_id, length(input) AS input_chars, length(full_text) > 30768 AS truncated, sha256(input) AS digest
FROM (SELECT doc_id, {_DOCUMENT} || text AS full_text, substr({_DOCUMENT} || text, 1, 30768) AS input FROM documents)""",
    "embed_hash_tf": f"""SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(weight, 6) AS weight
FROM {_weights_sql("documents", "doc_id", "text", _DOCUMENT)}""",
    "embed_requests": f"""WITH asked AS (SELECT doc_id, {_DOCUMENT} || text AS input FROM documents),
buckets AS (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(lower(word)), 1, 8) AS BIGINT) % 256 AS bucket
  FROM (SELECT doc_id, unnest(regexp_extract_all(input, '[A-Za-z0-9]+')) AS word FROM asked))
SELECT doc_id, CASE WHEN length(input) % 10 = 3 THEN 'ConnectionError: refused' END AS error,
  CASE WHEN length(input) % 10 = 3 THEN 0 ELSE coalesce(n, 0) END AS weights
FROM asked LEFT JOIN (SELECT doc_id, count(*) AS n FROM buckets GROUP BY 1) USING (doc_id)""",
    "vector_dim_check": """SELECT vec_id, CASE WHEN label = 9 THEN 'missing' WHEN label >= 4 THEN 'ok' ELSE 'wrong_size' END AS status
FROM embeddings""",
    "l2_normalize": """WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * label) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM s)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, round(CASE WHEN norm = 0 THEN v[i] ELSE v[i] / norm END, 6) AS value
FROM n, (SELECT unnest(range(1, 65)) AS i)""",
    "knn_cosine": f"""WITH {_KNN} SELECT q_id, doc_id, distance, CAST(place AS INTEGER) AS rank FROM ranked WHERE place <= 5""",
    "knn_cosine_threshold": f"""WITH {_KNN} SELECT q_id, doc_id, distance, CAST(place AS INTEGER) AS rank FROM ranked
WHERE place <= 5 AND distance <= {MAX_DISTANCE}""",
    "knn_recall": f"WITH {_KNN} SELECT count(*) AS neighbours, true AS recalled FROM ranked WHERE place <= 5",
    "context_block": f"""WITH {_KNN} SELECT q_id, {_HEADER} || string_agg('card ' || doc_id || chr(10) || 'label ' || label,
  {_RULE} ORDER BY place) AS context FROM ranked WHERE place <= 5 AND label <> 0 GROUP BY q_id""",
    "question_text": f"WITH {_ASKED} SELECT conv_id, turn, question FROM asked",
    "retrieve_distinct": f"""WITH {CARD_TEXTS}, {_ASKED},
questions AS (SELECT DISTINCT question FROM asked WHERE role = 'user' AND question <> ''),
q AS (SELECT * FROM {_weights_sql("questions", "question", "question", _QUERY)}),
d AS (SELECT * FROM {_weights_sql("texts", "doc_id", "embed_text", _DOCUMENT)}),
sims AS (SELECT question, doc_id, sum(q.weight * d.weight) AS sim FROM q JOIN d USING (bucket) GROUP BY 1, 2),
scored AS (
  SELECT question, doc_id, card, round(1 - coalesce(sim, 0), 6) AS distance
  FROM questions CROSS JOIN texts LEFT JOIN sims USING (question, doc_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY distance, doc_id) AS place FROM scored),
contexts AS (SELECT question, {_HEADER} || string_agg(card, {_RULE} ORDER BY place) AS context FROM best WHERE place <= 5 GROUP BY 1)
SELECT conv_id, turn, length(coalesce(context, '')) AS context_chars, sha256(coalesce(context, '')) AS digest
FROM asked LEFT JOIN contexts USING (question) WHERE role = 'user'""",
}
