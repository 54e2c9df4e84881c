"""Audit history: projects, comparison of two runs, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.topk import top


def _newest():
    return [F.col("generated_at").desc_nulls_last(), F.col("audit_id").desc()]


def runs(audits: DataFrame) -> DataFrame:
    """Each run once, its domain without ``www.`` and in lower case."""
    return audits.withColumn("domain", F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "")).dropDuplicates(["audit_id"])


def projects(audits: DataFrame) -> DataFrame:
    """``domain, audits, audit_id, generated_at, score, grade`` of the latest run of each domain."""
    r = runs(audits)
    n = r.groupBy("domain").agg(F.count("*").alias("audits"))
    return top(r, ["domain"], _newest(), 1).select("domain", "audit_id", "generated_at", "score", "grade").join(n, "domain")


def latest_two(audits: DataFrame) -> DataFrame:
    """``domain, before, after``: ids of the two latest runs of each domain that has two."""
    two = top(runs(audits), ["domain"], _newest(), 2)
    return two.groupBy("domain").agg(F.max(F.when(F.col("rank") == 2, F.col("audit_id"))).alias("before"), F.max(F.when(F.col("rank") == 1, F.col("audit_id"))).alias("after")).filter("before is not null")


def deltas(audits: DataFrame) -> DataFrame:
    """Score, error, warning and page differences between the two latest runs of each domain; null scores count as 0."""
    r = runs(audits).select("audit_id", F.coalesce("score", F.lit(0)).alias("score"), "errors", "warnings", "pages")
    j = latest_two(audits).join(r.select([F.col(c).alias(f"b_{c}") for c in r.columns]), F.col("before") == F.col("b_audit_id")).join(r.select([F.col(c).alias(f"a_{c}") for c in r.columns]), F.col("after") == F.col("a_audit_id"))
    return j.select("domain", "before", "after", *[(F.col(f"a_{c}") - F.col(f"b_{c}")).cast("long").alias(f"{c}_delta") for c in ("score", "errors", "warnings", "pages")])


def compare_issues(before: DataFrame, after: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """``keys, change``: issues resolved (only before) and created (only after). ``most`` limits each to its first rows."""
    one = lambda a, b, what: a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit(what))
    out = one(before, after, "resolved").unionByName(one(after, before, "created"))
    return top(out, ["change"], [F.col(k) for k in keys], most).drop("rank") if most else out


def category_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``category, before, after, delta`` for every category of the later run."""
    b = before.select("category", F.col("score").alias("before"))
    return after.select("category", F.col("score").alias("after")).join(b, "category", "left").select("category", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def retained(audits: DataFrame, most: int = 200) -> DataFrame:
    """The newest ``most`` runs: a bounded report, by top-k."""
    return runs(audits).orderBy(*_newest()).limit(most)


def save(result: DataFrame, path: str) -> None:
    """Appends runs to a history folder, partitioned by domain."""
    result.write.mode("append").partitionBy("domain").parquet(path)


def delete(spark, path: str, audit_id: str) -> None:
    """Rewrites only the domain partitions that hold the run, without it."""
    old = spark.read.parquet(path)
    touched = [r[0] for r in old.filter(F.col("audit_id") == audit_id).select("domain").distinct().collect()]
    if not touched:
        return
    kept = old.filter(F.col("domain").isin(touched) & (F.col("audit_id") != audit_id))
    from ..plans.lineage import stored

    kept = stored(kept, "history-kept")
    jvm = spark.sparkContext._jvm
    for d in touched:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/domain={d}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    kept.write.mode("append").partitionBy("domain").parquet(path)


def position(audits: DataFrame) -> DataFrame:
    """Runs with their number within the domain, oldest first."""
    return runs(audits).withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("generated_at", "audit_id")))
