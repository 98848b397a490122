"""The knowledge tables over the driver's tables: what stands for files, symbols, calls and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """files: documents; symbols: parts; calls: orders of parts; modules: nations; imports: links of pages."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def files(self) -> DataFrame:
        d = self.table("documents")
        path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return d.select("doc_id", path.alias("path"), F.col("source").alias("module"), F.col("text").alias("purpose"), F.sha2("text", 256).alias("content_hash"))

    @property
    def symbols(self) -> DataFrame:
        p = self.table("part")
        key = F.col("p_partkey").cast("string")
        return p.select(
            F.col("p_name").alias("name"),
            F.concat(F.lit("part:"), key).alias("qualified_name"),
            F.concat("p_brand", F.lit("/"), F.regexp_replace("p_name", " ", "-"), F.lit(".ts")).alias("file"),
            F.col("p_partkey").cast("int").alias("line"),
            F.col("p_type").alias("type"),
            F.col("p_brand").alias("module"),
            (F.col("p_size") > 25).alias("is_exported"),
            F.col("p_size").alias("complexity"),
        )

    @property
    def calls(self) -> DataFrame:
        item = self.table("lineitem")
        return item.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("caller"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("callee"))

    @property
    def contains(self) -> DataFrame:
        """(src, dst): region, nation, customer, order, part."""
        tag = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
        pair = lambda t, a, b: self.table(t).select(a.alias("src"), b.alias("dst"))
        return (
            pair("nation", tag("region", "n_regionkey"), tag("nation", "n_nationkey"))
            .unionByName(pair("customer", tag("nation", "c_nationkey"), tag("customer", "c_custkey")))
            .unionByName(pair("orders", tag("customer", "o_custkey"), tag("order", "o_orderkey")))
            .unionByName(pair("lineitem", tag("order", "l_orderkey"), tag("part", "l_partkey")))
        )

    @property
    def module_rows(self) -> DataFrame:
        """(src, dst, is_dynamic): nation of the supplier to nation of the customer, by item; every pair, at most nations squared."""
        s, c, n = self.table("supplier"), self.table("customer"), F.broadcast(self.table("nation"))
        i = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
        o = self.table("orders").select("o_orderkey", "o_custkey")
        a, b = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("src")), n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dst"))
        joined = i.join(o, i.l_orderkey == o.o_orderkey).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        per = joined.groupBy("s_nationkey", "c_nationkey").agg(F.bool_or(F.col("l_returnflag") == "N").alias("direct"))
        return per.join(a, "s_nationkey").join(b, "c_nationkey").select("src", "dst", (~F.col("direct")).alias("is_dynamic"))

    @property
    def links(self) -> DataFrame:
        """(page_id, host, dep): link targets of pages, with the host that relative ones belong to."""
        host = F.regexp_extract("url", "://([^/?#]*)", 1)
        return self.table("pages").select("page_id", host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dep"))

    @property
    def features(self) -> DataFrame:
        """Market segments of customers as groups of nations: (id, name, description, member)."""
        n = F.broadcast(self.table("nation"))
        c = self.table("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        return c.select(F.col("c_mktsegment").alias("id"), F.col("n_name").alias("member")).distinct()
