"""Queries of paged searches over planted pages that repeat ids, end early and fail."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.sources import search
from rolecall.sources.postings import AS_OF
from rolecall.staging import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_SIZE = 5
_PAGING = search.Paging("offset", "jobs", "id_icims", _SIZE, 10_000, total="hits")


def _query(sql: str) -> Callable:
    def put(query: Callable) -> Callable:
        QUERIES[query.__name__], SQL[query.__name__] = query, sql
        return query

    return put


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four queries a nation, whose hits are its customers, in pages of five.

    A page after the first begins with the last id of the one before; every fifth
    nation's third page repeats ids alone, so what follows it isn't read.
    """
    nations = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").where("n_nationkey is not null").distinct().orderBy("n_nationkey").limit(1000).collect()]
    queries = search.query_matrix("amazon", [(f"amazon:n{n}", f"n{n}") for n in nations], ["intern", "engineer"], ["India", "Remote"])
    asked = spark.createDataFrame([(q[0], int(q[3][1:]), q[0] // 2 % 2, q[0] % 2) for q in queries], "query int, n int, t int, l int")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    hits = F.broadcast(asked).join(customers, (F.col("n") == F.col("c_nationkey")) & F.expr("if(t = 0, c_custkey % 3 <> 1, c_custkey % 3 <> 0)"))
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("c_custkey")) - 1).withColumn("page", F.expr(f"r div {_SIZE}"))
    total = hits.groupBy("query").agg(F.count("*").alias("hits"))
    item = lambda title: F.struct(F.col("c_custkey").cast("string").alias("id_icims"), F.concat(F.lit(title), F.col("query").cast("string"), F.lit(" "), F.col("c_custkey").cast("string")).alias("title"))
    again = hits.where(f"r % {_SIZE} = {_SIZE - 1}").select("query", (F.col("page") + 1).alias("page"), "n", F.lit(-1).alias("r"), item("again ").alias("i"))
    own = hits.where("n % 5 <> 0 or page <> 2").select("query", "page", "n", "r", item("q").alias("i"))
    pages = own.unionByName(again).groupBy("query", "page", "n").agg(F.sort_array(F.collect_list(F.struct("r", "i"))).alias("items")).join(total, "query")
    pages = asked.select("query", "n", "t", "l").join(pages.drop("n"), "query", "left").select(
        "query", "n", "t", "l", F.coalesce("page", F.lit(0)).alias("page"), F.to_json(F.struct(F.coalesce(F.transform("items", lambda x: x["i"]), F.array().cast("array<struct<id_icims:string,title:string>>")).alias("jobs"), F.coalesce("hits", F.lit(0)).alias("hits"))).alias("body"),
    )
    codes = F.expr(
        "case when n % 7 = 3 and t = 1 and l = 0 and page = 0 then array(404, 200) when n % 7 = 4 and t = 0 and l = 1 and page = 0 then array(503, 429, 200)"
        " when n % 7 = 5 and t = 1 and l = 1 and page = 0 then array(503, null, 500, 200) when n % 7 = 6 and t = 0 and l = 0 and page = 1 then array(500, 500, 500) else array(200) end"
    )
    folder = f"{shared_dir(spark)}/searches/{uuid.uuid4().hex}"
    told = pages.select("query", (F.col("page") * _SIZE).cast("string").alias("cursor"), F.posexplode(codes).alias("k", "http_code"), "body")
    told.select("query", "cursor", (F.col("k") + 1).alias("attempt"), "http_code", F.when(F.col("http_code") == 200, F.col("body")).alias("body")).repartition("query").write.partitionBy("query").json(folder)
    return search.search(spark, folder, queries, _PAGING)


_HITS = f"""WITH hits AS (
  SELECT n_nationkey AS n, t, l, n_nationkey * 4 + t * 2 + l AS q, c_custkey AS c, row_number() OVER (PARTITION BY n_nationkey, t, l ORDER BY c_custkey) - 1 AS r, count(c_custkey) OVER (PARTITION BY n_nationkey, t, l) AS total
  FROM nation CROSS JOIN range(2) a(t) CROSS JOIN range(2) b(l) LEFT JOIN customer ON c_nationkey = n_nationkey AND CASE WHEN t = 0 THEN c_custkey % 3 <> 1 ELSE c_custkey % 3 <> 0 END
), told AS (SELECT *, n % 7 = 3 AND t = 1 AND l = 0 OR n % 7 = 5 AND t = 1 AND l = 1 OR n % 7 = 6 AND t = 0 AND l = 0 AND total > {_SIZE} AS failed FROM hits)"""


@_query(f"""{_HITS} SELECT '' || c AS source_job_id, 'amazon:n' || n AS scope, 'q' || min(q) || ' ' || c AS title FROM told WHERE NOT failed AND c IS NOT NULL AND (n % 5 <> 0 OR r < {2 * _SIZE}) GROUP BY n, c""")
def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each posting once, as the first query that found it gives it."""
    return search.read(_planted(spark, sf_dir), "amazon", AS_OF).select("source_job_id", "scope", "title")


@_query(f"{_HITS} SELECT 'amazon:n' || n AS scope FROM told GROUP BY n HAVING NOT bool_or(failed)")
def search_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of which no query failed."""
    return search.covered_scopes(_planted(spark, sf_dir))
