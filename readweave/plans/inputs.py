"""Inputs of the operators as projections of the shared tables, in Spark and (for the SQL side) in DuckDB.

blocks: aligned blocks of reads; genes: flat annotation; reads: one row for each read; sequences: bases of documents;
qualities: quality arrays, the whole hundredths of each component, multiplied in double precision; counts: a count matrix in long form; depth: depth by source and position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.genome import TILE, tiles_of_bases

GAP = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(c: str):
    return F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q, key = days("l_shipdate"), F.col("l_quantity").cast("int"), F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        key.alias("read_id"),
        F.col("l_linenumber").alias("blk"),
        F.col("l_partkey").alias("pk"),
        F.concat(F.lit("s"), key % 3).alias("source"),
        F.concat(F.lit("c"), key % 2).alias("chrom"),
        (key % 5 < 3).alias("fwd"),
        (d + 1).alias("st"),
        (d + q).alias("en"),
        F.round(F.col("l_discount") * 100).cast("int").alias("mapq"),
        (F.col("l_linenumber") * 60).alias("q1"),
        (F.col("l_linenumber") * 60 + q - 1).alias("q2"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = 1000 + F.col("n_nationkey") * 105
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("ord"),
        F.col("n_name").alias("gene"),
        F.concat(F.lit("c"), F.col("n_nationkey") % 2).alias("g_chrom"),
        (first + 1).cast("int").alias("g_st"),
        (first + 100).cast("int").alias("g_en"),
        (F.col("n_regionkey") % 2 == 0).alias("g_fwd"),
        F.col("n_regionkey").cast("int").alias("transcript"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("read_id"),
        (F.col("o_custkey") % 50).alias("cluster"),
        F.col("o_orderstatus").alias("source"),
        F.col("o_orderpriority").alias("type"),
        d.alias("st"),
        (d + F.floor(F.col("o_totalprice") / 1000).cast("int")).alias("en"),
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.regexp_replace(F.upper("text"), "[^ACGT]+", "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", seq.alias("seq"))


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id with the first half (a) and the second half (b) of every sequence; a base in the middle is left over."""
    n = F.floor(F.length("seq") / 2).cast("int")
    return sequences(spark, sf_dir).filter(F.length("seq") >= 2).select("id", F.substring(F.col("seq"), F.lit(1), n).alias("a"), F.substring(F.col("seq"), n + 1, n).alias("b"))


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("int")).alias("q"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("sample")).agg(F.count("*").alias("n"))


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000).cast("int")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), hour.alias("pos")).agg(F.count("*").alias("depth"), F.count_if(F.col("value") > 50).alias("errors"))


#: Length of the tail of A of both chromosomes.
TAIL = 12


def tiled(spark: SparkSession, sf_dir: str, size: int = TILE) -> DataFrame:
    """Two chromosomes in tiles: at every place the base that most sequences have there (by id), and a poly-A tail.

    Queries read it several times and it is small beside the documents, so it is kept."""
    s = sequences(spark, sf_dir)
    bases = s.select(F.concat(F.lit("c"), F.col("id") % 2).alias("chrom"), F.posexplode(F.split("seq", "")).alias("i", "base")).filter("base <> ''")
    counted = bases.groupBy("chrom", "i", "base").agg(F.count("*").alias("n"))
    best = counted.groupBy("chrom", (F.col("i") + 1).alias("pos")).agg(F.max_by("base", F.col("n") * 4 + F.instr(F.lit("ACGT"), F.col("base"))).alias("base"))
    tail = best.groupBy("chrom").agg(F.max("pos").alias("n")).select("chrom", F.explode(F.sequence(F.col("n") + 1, F.col("n") + TAIL)).alias("pos"), F.lit("A").alias("base"))
    return tiles_of_bases(best.unionByName(tail), size).persist()


_DAY = "CAST(datediff('day', DATE '1992-01-01', CAST({} AS DATE)) AS INTEGER)"
_SHIP, _ORDER = _DAY.format("l_shipdate"), _DAY.format("o_orderdate")
SQL = {
    "b": f"SELECT l_orderkey AS read_id, l_linenumber AS blk, l_partkey AS pk, concat('s', l_orderkey % 3) AS source, concat('c', l_orderkey % 2) AS chrom, l_orderkey % 5 < 3 AS fwd, {_SHIP} + 1 AS st, {_SHIP} + CAST(l_quantity AS INTEGER) AS en, CAST(round(l_discount * 100) AS INTEGER) AS mapq, l_linenumber * 60 AS q1, l_linenumber * 60 + CAST(l_quantity AS INTEGER) - 1 AS q2 FROM lineitem",
    "a": "SELECT CAST(n_nationkey AS INTEGER) AS ord, n_name AS gene, concat('c', n_nationkey % 2) AS g_chrom, CAST(1001 + n_nationkey * 105 AS INTEGER) AS g_st, CAST(1100 + n_nationkey * 105 AS INTEGER) AS g_en, n_regionkey % 2 = 0 AS g_fwd, CAST(n_regionkey AS INTEGER) AS transcript FROM nation",
    "r": f"SELECT o_orderkey AS read_id, o_custkey % 50 AS cluster, o_orderstatus AS source, o_orderpriority AS type, {_ORDER} AS st, {_ORDER} + CAST(floor(o_totalprice / 1000) AS INTEGER) AS en FROM orders",
    "s": "SELECT doc_id AS id, source, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents",
    "gn": f"WITH x AS (SELECT concat('c', id % 2) AS name, unnest(range(0, len(seq))) AS i, unnest(string_split(seq, '')) AS base FROM s WHERE seq <> ''), y AS (SELECT name, i, arg_max(base, n * 4 + strpos('ACGT', base)) AS base FROM (SELECT name, i, base, count(*) AS n FROM x GROUP BY ALL) GROUP BY ALL) SELECT name, string_agg(base, '' ORDER BY i) || '{'A' * TAIL}' AS seq FROM y GROUP BY name",
    "q": "SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 100) AS INTEGER)) AS q FROM embeddings",
    "c": "SELECT user_id AS id, event_type AS sample, count(*) AS n FROM events GROUP BY 1, 2",
    "d": "SELECT event_type AS source, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS INTEGER) AS pos, count(*) AS depth, count(*) FILTER (WHERE value > 50) AS errors FROM events GROUP BY 1, 2",
    # exons: islands of blocks more than GAP apart
    "e0": "SELECT *, max(en) OVER (PARTITION BY read_id ORDER BY st, en, blk, pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b",
    "e1": f"SELECT *, CAST(sum(CASE WHEN st - before <= {GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY read_id ORDER BY st, en, blk, pk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS exon FROM e0",
    "e": "SELECT read_id, any_value(source) AS source, any_value(chrom) AS chrom, any_value(fwd) AS fwd, exon, min(st) AS st, max(en) AS en FROM e1 GROUP BY read_id, exon",
    "rd": "SELECT read_id, any_value(source) AS source, any_value(chrom) AS chrom, any_value(fwd) AS fwd, min(st) AS st, max(en) AS en, count(*) AS n_exons, list(st ORDER BY exon) AS sts, list(en ORDER BY exon) AS ens FROM e GROUP BY read_id",
    # key parts: start, left and right sides of gaps, end
    "e2": "SELECT *, lead(st) OVER (PARTITION BY read_id ORDER BY exon) AS next_st FROM e",
    "pts": "SELECT read_id, chrom, exon AS i, en AS l, next_st AS r FROM e2 UNION ALL SELECT read_id, chrom, 0, st, NULL FROM rd",
    "lab": "SELECT read_id, i, coalesce((SELECT max_by(gene, g_st) FROM a WHERE g_chrom = chrom AND g_st <= l + 5), 'st.' || chrom) AS up, CASE WHEN r IS NULL THEN NULL ELSE coalesce((SELECT min_by(gene, g_st) FROM a WHERE g_chrom = chrom AND g_st >= r - 5), 'end.' || chrom) END AS down FROM pts",
    "k": "SELECT read_id, string_agg(up || coalesce(',' || down, ''), '_' ORDER BY i) AS cluster_key FROM lab GROUP BY read_id",
    "kr": "SELECT rd.*, cluster_key FROM rd JOIN k USING (read_id)",
}
NEEDS = {"gn": "s gn", "e": "b e0 e1 e", "rd": "b e0 e1 e rd", "pts": "b e0 e1 e rd e2 pts", "lab": "a b e0 e1 e rd e2 pts lab", "k": "a b e0 e1 e rd e2 pts lab k", "kr": "a b e0 e1 e rd e2 pts lab k kr"}


def sql(names: str, body: str) -> str:
    """DuckDB SQL over the named inputs."""
    want = dict.fromkeys(x for n in names.split() for x in NEEDS.get(n, n).split())
    order = [n for n in SQL if n in want]
    body = body.strip()
    start = next((k for k in ("WITH RECURSIVE ", "WITH ") if body.startswith(k)), "")
    own = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"{start or 'WITH '}{own}{', ' if start else ' '}{body.removeprefix(start)}"
