"""The numbered queries over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, embeddings, hard_negatives, language, language_model, licenses, mixing, personal_data, secrets, sharding, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in an occurrence of a benchmark window."""
    docs = table(spark, sf_dir, "documents")
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=[docs["doc_id"]])
    leak = F.col("leak")
    return found.select(
        "row.doc_id",
        leak["n_words"].alias("n_words"),
        leak["n_hit"].alias("n_hit"),
        F.size(leak["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leak["items"], ","), 256).alias("items_sha256"),
        (leak["n_hit"] > 0).alias("contaminated"),
    )


QUERIES["op4_decontamination"] = op4_decontamination
ORACLES["op4_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS width, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
widths AS (SELECT DISTINCT width FROM bw),
dw AS (
  SELECT rid, doc_id, width, i, array_to_string(ws[i:i + width - 1], ' ') AS gram
  FROM (SELECT rid, doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM d CROSS JOIN widths WHERE len(ws) >= width)),
m AS (SELECT rid, i, dw.width, item_id FROM dw JOIN bw ON dw.width = bw.width AND dw.gram = bw.gram),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + width)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES["op10_simhash"] = op10_simhash


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    rows, spans, drawn = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixing.taken(rows, spans, drawn).select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op1_mixing"] = op1_mixing


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law of near equal bytes."""
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(docs["text"], F.lit("")))
    placed = sharding.shard(docs, carry=[docs["doc_id"], crc.alias("text_crc32")])
    return placed.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        F.col("row.text_crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES["op3_sharding"] = op3_sharding


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


QUERIES["op6_toxicity"] = op6_toxicity


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs.select("doc_id", "text", "lang")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES["op7_language"] = op7_language


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and statements of every document."""
    own, docs = F.col("license"), table(spark, sf_dir, "documents")
    return licenses.scan(docs, carry=[docs["doc_id"]]).select(
        "row.doc_id",
        own["n_words"].alias("n_words"),
        F.size(own["places"]).cast("long").alias("n_base"),
        F.array_min(own["places"]).cast("long").alias("first_word"),
        F.array_max(own["places"]).cast("long").alias("last_word"),
        F.array_join(own["base_labels"], ",").alias("base_labels"),
        F.array_join(own["labels"], ",").alias("labels"),
        own["score"].alias("score"),
    )


QUERIES["op5_licenses"] = op5_licenses


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every document."""
    found = personal_data.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in personal_data.BASE]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("row.doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), added)


QUERIES["op9_personal_data"] = op9_personal_data


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES["op8_embeddings"] = op8_embeddings


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document's text."""
    scored, n = language_model.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES["op2_language_model"] = op2_language_model


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of every language."""
    return collocations.mine(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES["op12_collocations"] = op12_collocations
ORACLES["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, len AS k, array_to_string(w[i:i + len - 1], ' ') AS phrase
  FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM ws CROSS JOIN (VALUES (1), (2), (3)) AS l(len) WHERE len(w) >= len)),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, cut, x.f AS l, y.f AS r, (1000000 * c.f * c.f) // (x.f * y.f) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1) AS c
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, part, max(f) AS f
  FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k = 3))
  GROUP BY ALL),
stays AS (SELECT b.* FROM best AS b LEFT JOIN longer AS g ON g.lang = b.lang AND g.part = b.phrase WHERE b.k = 3 OR g.f IS NULL OR 100 * g.f < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stays)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of every document."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.find(docs, carry=[docs["doc_id"]])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in secrets.BASE]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("row.doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added)


QUERIES["op13_secrets"] = op13_secrets


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES["op11_hard_negatives"] = op11_hard_negatives
ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same,
         coalesce(CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT), 0) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.rid <> b.rid AND len(a.q) = len(b.q)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.aid, p.rid ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INT) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.aid = p.aid AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
