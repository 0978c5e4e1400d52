"""Text and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as op
from ..operators import vectors
from ..sources import tables as src
from .registry import query, r6

RULES = {"risk": ["loss", "error", "trash"], "growth": ["more", "tion"], "value": ["the", "la "]}


@query(
    "SELECT doc_id, CASE WHEN contains(lower(text), 'loss') OR contains(lower(text), 'error') OR contains(lower(text), 'trash') THEN 'risk' WHEN contains(lower(text), 'more') OR contains(lower(text), 'tion') THEN 'growth' WHEN contains(lower(text), 'the') OR contains(lower(text), 'la ') THEN 'value' ELSE 'other' END AS category FROM documents"
)
def keyword_category(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", op.category("text", RULES).alias("category"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]{3,}')) AS INT) AS n, coalesce(regexp_extract_all(text, '[0-9]{3,}')[1], '') AS first_one FROM documents")
def evidence_regex(spark, sf):
    found = op.evidence("text", "[0-9]{3,}")
    return src.table(spark, sf, "documents").select("doc_id", found.alias("e")).select("doc_id", F.size("e").alias("n"), F.coalesce(F.get("e", F.lit(0)), F.lit("")).alias("first_one"))


@query(
    """SELECT conv_id, turn, CAST(len(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 2))) AS INT) AS n_words FROM conversations"""
)
def token_sets(spark, sf):
    return src.table(spark, sf, "conversations").select("conv_id", "turn", F.size(op.tokens("text")).alias("n_words"))


def _claims(spark, sf):
    c = src.table(spark, sf, "conversations")
    words = op.tokens("text", least=6)
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("claim_id"), F.col("role").alias("agent_id"), F.col("conv_id").alias("category"), (F.col("turn") % 2).alias("direction"), words.alias("words"))


@query(
    """WITH c AS (SELECT conv_id * 100 + turn AS claim_id, role, conv_id, turn % 2 AS direction, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 6)) AS words FROM conversations),
    p AS (SELECT a.claim_id AS a, b.claim_id AS b, len(list_intersect(a.words, b.words)) AS n, len(a.words) + len(b.words) AS t FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.role < b.role AND a.direction <> b.direction)
    SELECT a, b, round(n / (t - n),6)+0.0 AS likeness FROM p WHERE n > 0 AND n / (t - n) >= 0.01::DOUBLE"""
)
def claim_conflicts(spark, sf):
    return op.conflicts(_claims(spark, sf), 0.01).select("a", "b", r6("likeness").alias("likeness"))


@query(
    """WITH c AS (SELECT conv_id * 100 + turn AS claim_id, role, conv_id, turn // 4 AS direction, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 6)) AS words FROM conversations),
    p AS (SELECT a.claim_id AS a, b.claim_id AS b, len(list_intersect(a.words, b.words)) AS n, len(a.words) + len(b.words) AS t FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.role < b.role AND a.direction = b.direction)
    SELECT a, b, round(n / (t - n),6)+0.0 AS likeness FROM p WHERE n > 0 AND n / (t - n) >= 0.01::DOUBLE"""
)
def claim_agreements(spark, sf):
    claims = _claims(spark, sf).withColumn("direction", F.floor(F.col("claim_id") % 100 / 4))
    return op.conflicts(claims, 0.01, agree=True).select("a", "b", r6("likeness").alias("likeness"))


@query(
    """WITH c AS (SELECT conv_id * 100 + turn AS claim_id, role AS agent_id, conv_id % 2 AS category, turn // 4 AS direction, text, length(text) / 1000 AS confidence,
      list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 2))) AS words FROM conversations),
    k AS (SELECT * FROM c WHERE len(words) > 0), h AS (SELECT category, direction, words, min(claim_id) AS node FROM k GROUP BY category, direction, words),
    e AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM h a JOIN h b ON a.category = b.category AND a.direction = b.direction AND a.node < b.node
      WHERE len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) >= 0.1::DOUBLE),
    o AS MATERIALIZED (SELECT h.category, h.direction, h.node, row_number() OVER (PARTITION BY h.category, h.direction ORDER BY h.node) AS i, coalesce(n.earlier, []) AS earlier FROM h LEFT JOIN (SELECT b, list(a) AS earlier FROM e GROUP BY b) n ON n.b = h.node),
    walk AS (SELECT category, direction, i, node, node AS leader, [node] AS led FROM o WHERE i = 1 UNION ALL
      SELECT o.category, o.direction, o.i, o.node, coalesce(list_min(list_intersect(w.led, o.earlier)), o.node), CASE WHEN len(list_intersect(w.led, o.earlier)) = 0 THEN list_append(w.led, o.node) ELSE w.led END
      FROM walk w JOIN o ON o.category = w.category AND o.direction = w.direction AND o.i = w.i + 1),
    m AS (SELECT k.*, walk.leader FROM k JOIN h USING (category, direction, words) JOIN walk ON walk.node = h.node)
    SELECT leader, CAST(category AS VARCHAR) AS category, CAST(direction AS VARCHAR) AS direction, arg_min(text, (-length(text), claim_id)) AS representative, count(*) AS claims, count(DISTINCT agent_id) AS agents, round(avg(confidence),6)+0.0 AS confidence
    FROM m GROUP BY leader, category, direction HAVING count(DISTINCT agent_id) >= 2""",
    recursive=True,
)
def consensus_clusters(spark, sf):
    """What agents of different roles say alike, within two topics (groups of conversations) and directions (early and late turns)."""
    c = src.table(spark, sf, "conversations")
    claims = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("claim_id"), F.col("role").alias("agent_id"), (F.col("conv_id") % 2).alias("category"), F.floor(F.col("turn") / 4).alias("direction"), op.tokens("text").alias("words"), "text", (F.length("text") / 1000).alias("confidence"))
    found = op.consensus(claims, 0.1)
    return found.select("leader", "category", "direction", "representative", "claims", "agents", r6("confidence").alias("confidence"))


@query(
    """WITH s AS (SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS likeness FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)
    SELECT query, vec_id, round(likeness,6)+0.0 AS likeness FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(likeness, 12) DESC, vec_id) AS nth FROM s) WHERE nth <= 5"""
)
def vector_topk(spark, sf):
    """The five nearest of all vectors to each whose id is divisible by 100."""
    v = src.table(spark, sf, "embeddings")
    return vectors.nearest_of_each(v, v.where("vec_id % 100 = 0"), 5).select("query", "vec_id", r6("likeness").alias("likeness"))


@query("WITH c AS (SELECT conv_id, len(regexp_extract_all(text, '[0-9]+')) AS n FROM conversations) SELECT conv_id, count(*) AS claims, round(avg(CASE WHEN n >= 3 THEN 100 WHEN n = 2 THEN 70 WHEN n = 1 THEN 35 ELSE 0 END),6)+0.0 AS score FROM c GROUP BY conv_id")
def evidence_score(spark, sf):
    n = F.size(op.evidence("text", "[0-9]+"))
    level = F.when(n >= 3, "strong").when(n == 2, "moderate").when(n == 1, "weak").otherwise("missing")
    c = src.table(spark, sf, "conversations").select("conv_id", level.alias("level"))
    return op.evidence_score(c, "conv_id").select("conv_id", "claims", r6("score").alias("score"))


@query("SELECT doc_id FROM documents WHERE lower(lang) = 'en' AND (contains(lower(text), 'the re') OR contains(lower(source), 'the re'))")
def metadata_search(spark, sf):
    return op.search(src.table(spark, sf, "documents"), "The re", ["text", "source"], lang="EN").select("doc_id")
