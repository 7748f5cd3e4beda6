"""The base relations as projections of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONTHS = "(year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1"

SQL = f"""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer),
facts AS (SELECT o_custkey AS src, (o_orderkey * 7919 + 13) % n.n AS dst, CASE WHEN o_orderkey % 4 = 0 THEN 'interface_resolved' ELSE 'direct_call' END AS prov, o_orderkey AS site,
  CAST({MONTHS} AS BIGINT) AS vf, CASE WHEN o_orderstatus <> 'O' THEN CAST({MONTHS} + 1 + o_orderkey % 12 AS BIGINT) END AS vt
  FROM orders, n),
edges AS (SELECT o_custkey AS src, (o_orderkey * 7919 + 13) % n.n AS dst, CASE WHEN o_orderkey % 4 = 0 THEN 'interface_resolved' ELSE 'direct_call' END AS prov, o_orderkey AS site
  FROM orders, n),
roots AS (SELECT c_custkey AS sym FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'),
commits AS (SELECT DISTINCT vf AS seq, sha256('c' || vf) AS commit_hash FROM facts),
type_ifaces AS (SELECT p_type || '#' || p_brand AS iface, p_partkey AS type FROM part),
methods AS (SELECT p_partkey AS type, k AS method FROM part, (VALUES (1), (2), (3), (4), (5), (6), (7)) AS v(k) WHERE (p_partkey + p_size * 7 + k * 11) % 13 = 0),
refs AS (SELECT DISTINCT l_suppkey AS caller, p_type || '#' || p_brand AS iface, l_linenumber AS method
  FROM lineitem JOIN part ON p_partkey = l_partkey),
symbols AS (SELECT user_id AS path, event_id AS symbol, 10 * row_number() OVER w AS line_start, 10 * row_number() OVER w + 9 AS line_end FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
hunks AS (SELECT user_id AS path, CAST(regexp_extract(props, ': *([0-9]+)', 1) AS BIGINT) AS h_start, CAST(regexp_extract(props, ': *([0-9]+)', 1) AS BIGINT) + 3 AS h_end FROM events WHERE regexp_matches(props, ': *[0-9]')),
files AS (SELECT o_custkey AS file, CAST({MONTHS} AS BIGINT) AS seq, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS hash FROM orders GROUP BY 1, 2),
versions AS (SELECT file, max_by(hash, seq) FILTER (seq <= 40) AS old_hash, max_by(hash, seq) FILTER (seq <= 41) AS new_hash FROM files GROUP BY file),
modules AS (SELECT s_suppkey AS module, 'v1.' || s_nationkey || '.' || s_suppkey % 10 AS version, s_suppkey % 50 AS valid_from, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 50 + 20 END AS valid_to FROM supplier),
advisories AS (SELECT 'OSV-' || c_custkey AS osv_id, c_custkey % s.n + 1 AS module, c_custkey % 20 AS introduced, c_custkey % 20 + 9 AS fixed, c_custkey AS sym FROM customer, (SELECT count(*) AS n FROM supplier) s),
texts AS (SELECT doc_id AS symbol, source, sha256(text) AS hash_after, lag(sha256(text)) OVER w AS hash_before, CAST(strlen(text) % 7 AS VARCHAR) AS sig_after, lag(CAST(strlen(text) % 7 AS VARCHAR)) OVER w AS sig_before
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
"""


class Workload:
    """Lazily read base relations."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _calls(self, orders: DataFrame) -> DataFrame:
        n = self.read("customer").agg(F.count("*").alias("n"))  # one number
        prov = F.when(F.col("o_orderkey") % 4 == 0, "interface_resolved").otherwise("direct_call")
        joined = orders.withColumn("n", F.lit(n.first()["n"]))
        return joined.select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7919 + 13) % F.col("n")).alias("dst"), prov.alias("prov"), F.col("o_orderkey").alias("site"), *[c for c in ("vf", "vt") if c in orders.columns])

    def edges(self) -> DataFrame:
        return self._calls(self.read("orders"))

    def facts(self) -> DataFrame:
        orders = self.read("orders").withColumn("vf", F.expr(f"cast({MONTHS} as bigint)"))
        return self._calls(orders.withColumn("vt", F.expr("case when o_orderstatus <> 'O' then cast(vf + 1 + o_orderkey % 12 as bigint) end")))

    def roots(self) -> DataFrame:
        return self.read("customer").where("c_nationkey = 7 and c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("sym"))

    def commits(self) -> DataFrame:
        return self.facts().select(F.col("vf").alias("seq")).distinct().withColumn("commit_hash", F.sha2(F.concat(F.lit("c"), F.col("seq").cast("string")), 256))

    def type_ifaces(self) -> DataFrame:
        return self.read("part").select(F.concat_ws("#", "p_type", "p_brand").alias("iface"), F.col("p_partkey").alias("type"))

    def methods(self) -> DataFrame:
        numbers = F.explode(F.array(*[F.lit(i) for i in range(1, 8)]))
        return self.read("part").select("p_partkey", "p_size", numbers.alias("method")).where("(p_partkey + p_size * 7 + method * 11) % 13 = 0").select(F.col("p_partkey").alias("type"), "method")

    def refs(self) -> DataFrame:
        lines = self.read("lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
        parts = self.type_ifaces()
        return lines.join(parts, lines["l_partkey"] == parts["type"]).select(F.col("l_suppkey").alias("caller"), "iface", F.col("l_linenumber").alias("method")).distinct()

    def symbols(self) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        start = 10 * F.row_number().over(w).cast("long")
        return self.read("events").select(F.col("user_id").alias("path"), F.col("event_id").alias("symbol"), start.alias("line_start"), (start + 9).alias("line_end"))

    def hunks(self) -> DataFrame:
        start = F.regexp_extract("props", r": *([0-9]+)", 1)
        return self.read("events").withColumn("s", start).where("s <> ''").select(F.col("user_id").alias("path"), F.col("s").cast("long").alias("h_start"), (F.col("s").cast("long") + 3).alias("h_end"))

    def versions(self) -> DataFrame:
        orders = self.read("orders").select(F.col("o_custkey").alias("file"), F.expr(f"cast({MONTHS} as bigint)").alias("seq"), "o_orderkey")
        files = orders.groupBy("file", "seq").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ","), 256).alias("hash"))
        at = lambda s: F.max_by("hash", F.when(F.col("seq") <= s, F.col("seq")))
        return files.groupBy("file").agg(F.when(F.min("seq") <= 40, at(40)).alias("old_hash"), F.when(F.min("seq") <= 41, at(41)).alias("new_hash"))

    def texts(self) -> DataFrame:
        w = Window.partitionBy("source").orderBy("symbol")
        made = self.read("documents").select(F.col("doc_id").alias("symbol"), "source", F.sha2(F.col("text").cast("binary"), 256).alias("hash_after"), (F.octet_length("text") % 7).cast("string").alias("sig_after"))
        return made.withColumn("hash_before", F.lag("hash_after").over(w)).withColumn("sig_before", F.lag("sig_after").over(w))

    def modules(self) -> DataFrame:
        start = F.col("s_suppkey") % 50
        version = F.concat(F.lit("v1."), F.col("s_nationkey").cast("string"), F.lit("."), (F.col("s_suppkey") % 10).cast("string"))
        return self.read("supplier").select(F.col("s_suppkey").alias("module"), version.alias("version"), start.alias("valid_from"), F.when(F.col("s_suppkey") % 3 == 0, start + 20).alias("valid_to"))

    def advisories(self) -> DataFrame:
        n, key, minor = self.read("supplier").count(), F.col("c_custkey"), lambda x: F.concat(F.lit("v1."), x.cast("string"), F.lit(".0"))
        return self.read("customer").select(F.concat(F.lit("OSV-"), key.cast("string")).alias("osv_id"), (key % n + 1).alias("module"), minor(key % 20).alias("introduced"), minor(key % 20 + 9).alias("fixed"), key.alias("sym"))
