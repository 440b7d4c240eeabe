"""Queries over benchmark results: spread, percentiles by index, extensions, ranks, quality, cache eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from papyra.plans.registry import query
from papyra.session import table

#: Repeated rows count once; spellings of a framework fold; negative and missing durations are no measurement.
_CLEAN = """r AS (SELECT DISTINCT run_id, lower(trim(framework)) AS framework, lower(trim(file_extension)) AS ext, file_path, file_size, success, duration_ms AS d, metrics.peak_memory_bytes AS mem,
  CASE WHEN metrics.throughput_bytes_per_sec::VARCHAR NOT IN ('nan', 'inf', '-inf') THEN metrics.throughput_bytes_per_sec END AS tp, quality.f1_score_text AS f1t, quality.f1_score_numeric AS f1n, quality.quality_score AS q FROM benchmark_results),
  ok AS (SELECT * FROM r WHERE success AND d >= 0 AND d::VARCHAR NOT IN ('nan', 'inf'))"""


def runs(spark, sf_dir) -> DataFrame:
    tp = F.col("metrics.throughput_bytes_per_sec")
    return table(spark, sf_dir, "benchmark_results").select(
        "run_id", F.lower(F.trim("framework")).alias("framework"), F.lower(F.trim("file_extension")).alias("ext"), "file_path", "file_size", "success", F.col("duration_ms").alias("d"),
        F.col("metrics.peak_memory_bytes").alias("mem"), F.when(tp < 1e300, tp).alias("tp"), F.col("quality.f1_score_text").alias("f1t"), F.col("quality.f1_score_numeric").alias("f1n"), F.col("quality.quality_score").alias("q"),
    ).distinct()


def measured(spark, sf_dir) -> DataFrame:
    return runs(spark, sf_dir).filter("success and d >= 0 and d < 1e300")


def index_percentiles(df: DataFrame, value: str, key: str, shares: dict[str, float]) -> DataFrame:
    """(key, one column a share): the sorted value at index min(floor(n p), n - 1) of each group, exactly.

    A histogram by group, added up within partitions first, tells the narrow range that holds each index; only the
    values of those ranges are sorted. So a group with a third of all rows is never sorted or gathered as one.
    """
    narrow = F.floor(F.log1p(F.abs(value)) * 256) * F.signum(F.col(value))
    own = df.filter(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"), narrow.alias("b"))
    counts = own.groupBy("k", "b").agg(F.count("*").alias("c"))
    by = Win.partitionBy("k")
    before = F.sum("c").over(by.orderBy("b").rowsBetween(Win.unboundedPreceding, Win.currentRow)) - F.col("c")
    placed = counts.select("k", "b", "c", before.alias("before"), F.sum("c").over(by).alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in shares.items()]))
    at = F.least(F.floor(F.col("n") * F.col("w.p")), F.col("n") - 1)
    spots = placed.select("*", wanted.alias("w")).withColumn("at", at).filter("before <= at and at < before + c").select("k", "b", "w.name", (F.col("at") - F.col("before")).alias("at"))
    rank = F.row_number().over(Win.partitionBy("k", "name").orderBy("v")) - 1
    # a null group is a group as well
    found = own.join(spots.select(F.col("k").alias("k2"), F.col("b").alias("b2"), "name", "at"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("b") == F.col("b2")))
    found = found.withColumn("r", rank).filter("r = at")
    return found.groupBy("k").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in shares]).withColumnRenamed("k", key)


@query(f"WITH {_CLEAN} SELECT framework, count(*) AS n, round(avg(d), 4) AS mean, round(var_pop(d), 3) AS variance, round(stddev_pop(d), 4) AS std FROM ok GROUP BY framework")
def variance_by_framework(spark, sf_dir):
    return measured(spark, sf_dir).groupBy("framework").agg(F.count("*").alias("n"), F.round(F.avg("d"), 4).alias("mean"), F.round(F.var_pop("d"), 3).alias("variance"), F.round(F.stddev_pop("d"), 4).alias("std"))


def _pct(p: float) -> str:
    return f"list_sort(list(d))[least(floor(count(*) * {p})::BIGINT, count(*) - 1) + 1]"


@query(f"WITH {_CLEAN} SELECT framework, {_pct(0.5)} AS p50, {_pct(0.95)} AS p95, {_pct(0.99)} AS p99 FROM ok GROUP BY framework")
def percentile_by_framework(spark, sf_dir):
    return index_percentiles(measured(spark, sf_dir), "d", "framework", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"""WITH {_CLEAN}, a AS (SELECT ext, count(*) AS n, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM r GROUP BY ext), b AS (SELECT ext, round(avg(d), 4) AS mean_duration, {_pct(0.95)} AS p95, round(avg(tp), 2) AS mean_throughput FROM ok GROUP BY ext)
  SELECT a.ext, n, success_rate, mean_duration, p95, mean_throughput FROM a LEFT JOIN b ON a.ext IS NOT DISTINCT FROM b.ext""")
def extension_stats(spark, sf_dir):
    a = runs(spark, sf_dir).groupBy("ext").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)), 6).alias("success_rate"))
    ok = measured(spark, sf_dir)
    b = ok.groupBy(F.col("ext").alias("e")).agg(F.round(F.avg("d"), 4).alias("mean_duration"), F.round(F.avg("tp"), 2).alias("mean_throughput"))
    p = index_percentiles(ok, "d", "ext", {"p95": 0.95}).withColumnRenamed("ext", "f")
    joined = a.join(b, F.col("ext").eqNullSafe(F.col("e")), "left").join(p, F.col("ext").eqNullSafe(F.col("f")), "left")
    return joined.select("ext", "n", "success_rate", "mean_duration", "p95", "mean_throughput")


@query(f"""WITH {_CLEAN}, a AS (SELECT framework, avg(d) AS mean, avg(tp) AS tp, avg(mem) AS mem FROM ok GROUP BY framework), base AS (SELECT mean FROM a ORDER BY mean, framework LIMIT 1)
  SELECT framework, round(a.mean, 4) AS mean_duration, rank() OVER (ORDER BY tp DESC) AS throughput_rank, rank() OVER (ORDER BY mem) AS memory_rank, round((a.mean - base.mean) / base.mean * 100, 4) AS delta_percent FROM a, base""")
def framework_ranking(spark, sf_dir):
    """Ranks by throughput and memory, and the mean duration against the fastest: one row a framework, so the windows are small."""
    a = measured(spark, sf_dir).groupBy("framework").agg(F.avg("d").alias("mean"), F.avg("tp").alias("tp"), F.avg("mem").alias("mem"))
    every = Win.partitionBy()
    base = F.min("mean").over(every)
    return a.select("framework", F.round("mean", 4).alias("mean_duration"), F.rank().over(every.orderBy(F.desc("tp"))).alias("throughput_rank"), F.rank().over(every.orderBy("mem")).alias("memory_rank"), F.round((F.col("mean") - base) / base * 100, 4).alias("delta_percent"))


@query(f"WITH {_CLEAN} SELECT framework, count(q) AS n, round(avg(f1t), 6) AS f1_text, round(avg(f1n), 6) AS f1_numeric, round(avg(q), 6) AS quality, coalesce(stddev_pop(q) <= 0.2, false) AS reliable FROM r GROUP BY framework")
def quality_analysis(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("framework").agg(F.count("q").alias("n"), F.round(F.avg("f1t"), 6).alias("f1_text"), F.round(F.avg("f1n"), 6).alias("f1_numeric"), F.round(F.avg("q"), 6).alias("quality"), F.coalesce(F.stddev_pop("q") <= 0.2, F.lit(False)).alias("reliable"))


@query("""SELECT run_id, n_iterations, spread FROM (SELECT DISTINCT run_id, len(iterations) AS n_iterations, round(list_max(list_transform(iterations, lambda i: i.duration_ms)) - list_min(list_transform(iterations, lambda i: i.duration_ms)), 4) AS spread FROM benchmark_results WHERE iterations IS NOT NULL)""")
def iteration_spread(spark, sf_dir):
    d = F.transform("iterations", lambda i: i["duration_ms"])
    rows = table(spark, sf_dir, "benchmark_results").filter("iterations is not null")
    return rows.select("run_id", F.size("iterations").cast("bigint").alias("n_iterations"), F.round(F.array_max(d) - F.array_min(d), 4).alias("spread")).distinct()


@query("""WITH f AS (SELECT file_path, max(file_size) AS size, max(run_at) AS seen FROM benchmark_results WHERE file_size IS NOT NULL AND file_path IS NOT NULL GROUP BY file_path),
  t AS (SELECT *, sum(size) OVER () AS total, sum(size) OVER (ORDER BY seen NULLS FIRST, file_path) AS run FROM f) SELECT file_path, size, run - size < total - total // 2 AS evicted FROM t""")
def cache_eviction(spark, sf_dir):
    """Oldest files go until half of the total is left.

    The running total over a global order is found by blocks: sums of time buckets first, then within each bucket.
    """
    files = table(spark, sf_dir, "benchmark_results").filter("file_size is not null and file_path is not null").groupBy("file_path").agg(F.max("file_size").alias("size"), F.max("run_at").alias("at"))
    files = files.withColumn("bucket", F.coalesce(F.unix_date(F.to_date("at")), F.lit(-1_000_000)))
    sums = files.groupBy("bucket").agg(F.sum("size").alias("s"))  # one row a day
    before = sums.select("bucket", (F.sum("s").over(Win.orderBy("bucket")) - F.col("s")).alias("before"), F.sum("s").over(Win.partitionBy()).alias("total"))
    run = F.sum("size").over(Win.partitionBy("bucket").orderBy(F.asc_nulls_first("at"), "file_path")) + F.col("before")
    return files.join(before, "bucket").select("file_path", "size", (run - F.col("size") < F.col("total") - F.floor(F.col("total") / 2)).alias("evicted"))


#: Bytes that the cache's disk is taken to have.
CAPACITY = 10**12


@query(f"SELECT count(DISTINCT file_path) AS files, sum(size) AS bytes, greatest(0, {CAPACITY} - sum(size))::BIGINT AS free_bytes, min(seen) AS oldest, max(seen) AS newest FROM (SELECT file_path, max(file_size) AS size, max(run_at) AS seen FROM benchmark_results WHERE file_path IS NOT NULL GROUP BY file_path)")
def cache_stats(spark, sf_dir):
    files = table(spark, sf_dir, "benchmark_results").filter("file_path is not null").groupBy("file_path").agg(F.max("file_size").alias("size"), F.max("run_at").alias("at"))
    return files.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.greatest(F.lit(0), F.lit(CAPACITY) - F.sum("size")).alias("free_bytes"), F.min("at").alias("oldest"), F.max("at").alias("newest"))
