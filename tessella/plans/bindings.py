"""The driver's tables seen as candidates, jobs, applications and text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.sources.io import read_table

REQUIRED, PREFERRED = 8, 4


class Tables:
    """Named views of one data folder; every attribute is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @property
    def bought(self) -> DataFrame:
        """Part names that a customer has bought, once for every time."""
        lines = self.orders.join(self.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("candidate_id"), "l_partkey")
        return lines.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select("candidate_id", F.col("p_name").alias("skill"))

    @property
    def candidate_skills(self) -> DataFrame:
        """Distinct part names that a customer has bought."""
        return self.bought.distinct()

    @property
    def job_skills(self) -> DataFrame:
        """The part names that a supplier sells most: the first eight required, the next four preferred."""
        sold = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        by_name = sold.groupBy(F.col("l_suppkey").alias("job_id"), F.col("p_name").alias("skill")).agg(F.sum("l_quantity").alias("q"))
        n = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("q"), "skill"))
        tier = F.when(F.col("n") <= REQUIRED, "required").otherwise("preferred")
        return by_name.withColumn("n", n).where(F.col("n") <= REQUIRED + PREFERRED).select("job_id", "skill", tier.alias("tier"), "n")

    @property
    def candidates(self) -> DataFrame:
        placed = self.orders.groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.count("*").alias("projects"))
        own = self.customer.select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), (F.floor(F.abs("c_acctbal")) % 10).cast("double").alias("years"))
        return own.join(placed, "candidate_id", "left").withColumn("projects", F.coalesce("projects", F.lit(0)))

    @property
    def jobs(self) -> DataFrame:
        return self.supplier.select(F.col("s_suppkey").alias("job_id"), F.col("s_nationkey").alias("job_nation"), (F.floor(F.abs("s_acctbal")) % 6).cast("double").alias("wanted"))


# The same views in SQL, for the oracle.
CANDIDATE_SKILLS = "SELECT DISTINCT o_custkey AS candidate_id, p_name AS skill FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey"
JOB_SKILLS = """SELECT job_id, skill, CASE WHEN n <= 8 THEN 'required' ELSE 'preferred' END AS tier, n FROM (
  SELECT l_suppkey AS job_id, p_name AS skill, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, p_name) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE n <= 12"""
CANDIDATES = """SELECT c_custkey AS candidate_id, c_name AS name, c_nationkey AS nation, (floor(abs(c_acctbal))::BIGINT % 10)::DOUBLE AS years,
  coalesce(projects, 0) AS projects FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS projects FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
JOBS = "SELECT s_suppkey AS job_id, s_nationkey AS job_nation, (floor(abs(s_acctbal))::BIGINT % 6)::DOUBLE AS wanted FROM supplier"
