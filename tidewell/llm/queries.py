"""Queries of the operators for training data, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.digest import series_quantiles
from tidewell.llm.leakage import find_leaks
from tidewell.llm.packing import CAPACITY, pack_documents
from tidewell.llm.residue import find_residue
from tidewell.llm.runs import collapse_runs
from tidewell.queries_data import CURRENT
from tidewell.sources.tables import table


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = series_quantiles(table(spark, d, "meas"), [0.5, 0.9, 0.99])
    return out.select("id", "p", "n", "position", F.col("exact").alias("value"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = series_quantiles(table(spark, d, "meas"), [0.5, 0.99], min_n=200)
    value = F.coalesce("exact", "estimate")
    both = out.groupBy("id").agg(F.max(F.when(F.col("p") == 0.5, value)).alias("median"), F.max(F.when(F.col("p") == 0.99, value)).alias("high"))
    return both.where((F.col("median") > 0) & (F.col("high") > F.col("median") * 10)).select("id")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(table(spark, d, "meas")).select("id", "time_from", "time_to", "n", "duration", "flag", "value")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(table(spark, d, "meas"), min_n=3).select("id", "time_from", "time_to")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all containers, put together again by document."""
    pieces = F.array_sort(F.collect_list(F.struct("piece", "text")))
    return p7_containers(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("whole")).select(
        "doc_id", F.length("whole").cast("long").alias("n_chars"), F.md5(F.encode("whole", "UTF-8")).alias("digest"))


def p7_requirements(spark: SparkSession, d: str) -> DataFrame:
    """What any filling must fulfil: texts and characters in it, containers beyond their capacity, texts split though they would fit, and whether it has
    at most 2 % more containers than all tokens need, and one for each of the table's files."""
    docs = table(spark, d, "documents")
    packed = pack_documents(docs)
    whole = packed.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.sum("n_tokens").alias("tokens"), F.max("n_pieces").alias("n_pieces"))
    texts = whole.agg(F.count(F.lit(1)).alias("n_texts"), F.sum("chars").alias("n_chars"), F.count_if((F.col("n_pieces") > 1) & (F.col("tokens") <= CAPACITY)).alias("split_in_vain"))
    bins = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("n_tokens").alias("tokens")).agg(
        F.count_if(F.col("tokens") > CAPACITY).alias("over_full"),
        (F.count(F.lit(1)) <= F.ceil(F.sum("tokens") / CAPACITY * 1.02) + F.lit(docs.rdd.getNumPartitions())).alias("filled"))
    one = F.lit(1)
    return texts.withColumn("_k", one).join(bins.withColumn("_k", one), "_k").drop("_k")  # one row each


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents").select("doc_id", "text")).where(F.col("residue").isNotNull()).select("doc_id")


P1_PERCENTILES_SQL = f"""WITH {CURRENT}, v AS (SELECT id, count(*) AS n, list_sort(list(value)) AS v FROM cur GROUP BY id),
ps AS (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS p)
SELECT id, p, n, floor(p * n)::BIGINT AS position, v[floor(p * n)::BIGINT + 1] AS value FROM v, ps"""

P1_FOUND_SQL = f"""WITH {CURRENT}, v AS (SELECT id, count(*) AS n, list_sort(list(value)) AS v FROM cur GROUP BY id HAVING count(*) >= 200)
SELECT id FROM v WHERE v[floor(0.5::DOUBLE * n)::BIGINT + 1] > 0 AND v[floor(0.99::DOUBLE * n)::BIGINT + 1] > 10 * v[floor(0.5::DOUBLE * n)::BIGINT + 1]"""

P4_RUNS_SQL = f"""WITH {CURRENT}, m AS (
  SELECT *, CASE WHEN flag = lag(flag) OVER s AND abs(value - lag(value) OVER s) < 1e-5 THEN 0 ELSE 1 END AS start FROM cur WINDOW s AS (PARTITION BY id ORDER BY time)
), g AS (SELECT *, sum(start) OVER (PARTITION BY id ORDER BY time) AS run FROM m)
SELECT id, min(time) AS time_from, max(time) AS time_to, count(*) AS n, max(time) - min(time) AS duration, min(flag) AS flag, arg_min(value, time) AS value
FROM g GROUP BY id, run"""

P4_FOUND_SQL = f"SELECT id, time_from, time_to FROM ({P4_RUNS_SQL}) WHERE n >= 3"

P7_ROUNDTRIP_SQL = "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM documents"

P7_REQUIREMENTS_SQL = "SELECT count(*) AS n_texts, sum(length(text))::BIGINT AS n_chars, 0::BIGINT AS split_in_vain, 0::BIGINT AS over_full, true AS filled FROM documents"

P8_FOUND_SQL = r"""WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 9)) AS k FROM iw)),
one AS (SELECT g, min(item_id) AS item_id FROM ig GROUP BY g HAVING count(*) = 1),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
dg AS (SELECT doc_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 9)) AS k FROM dw))
SELECT DISTINCT doc_id, item_id FROM dg JOIN one USING (g)"""

QUERIES = {
    "p1_found": p1_found, "p1_percentiles": p1_percentiles, "p4_found": p4_found, "p4_runs": p4_runs, "p7_containers": p7_containers, "p7_roundtrip": p7_roundtrip, "p7_requirements": p7_requirements,
    "p8_found": p8_found, "p9_found": p9_found,
}
SQL = {"p1_found": P1_FOUND_SQL, "p1_percentiles": P1_PERCENTILES_SQL, "p4_found": P4_FOUND_SQL, "p4_runs": P4_RUNS_SQL, "p7_roundtrip": P7_ROUNDTRIP_SQL, "p7_requirements": P7_REQUIREMENTS_SQL, "p8_found": P8_FOUND_SQL}
