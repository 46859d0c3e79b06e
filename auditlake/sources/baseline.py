"""Saved reports and tables as baselines, and what a path holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.plans.schema import PASSES
from auditlake.sources.repo import read_repo
from auditlake.sources.session import read_sessions

_SAVED = (
    "findings array<struct<id:string,title:string,status:string,confidence:double,triggering_signal:string,"
    "citation:struct<url:string,version:string>,suggested_controls:array<string>,cross_refs:array<string>>>"
)


def read_baseline(spark: SparkSession, path: str, scan_id: str) -> DataFrame:
    """Findings of a saved JSON report, as ``baseline_diff`` takes them, for the scan they are compared with.

    ``id``, ``title`` and ``triggering_signal`` must be there, other fields
    have defaults and further ones are ignored.  What isn't such a report is an error.
    """
    report = spark.read.schema(_SAVED).option("multiLine", True).option("mode", "FAILFAST").json(path)
    found = report.select(F.explode("findings").alias("f")).select("f.*")
    lacking = found.filter("id IS NULL OR title IS NULL OR triggering_signal IS NULL")
    if not lacking.isEmpty():
        raise ValueError(f"{path}: a finding lacks id, title or triggering_signal")
    none = F.array().cast("array<string>")
    return found.select(
        F.lit(scan_id).alias("scan_id"), "id", "title", F.coalesce("status", F.lit("official")).alias("status"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "triggering_signal",
        F.coalesce("citation.url", F.lit("")).alias("citation_url"), F.coalesce("citation.version", F.lit("")).alias("citation_version"), F.coalesce("suggested_controls", none).alias("suggested_controls"), F.coalesce("cross_refs", none).alias("cross_refs"),
    )


#: What a finding is told apart by, and what a table of findings is bucketed by.
KEY = ["scan_id", "id", "triggering_signal"]


def save_baseline(findings: DataFrame, table: str, buckets: int | None = None) -> None:
    """Findings as a table that later runs are compared with: bucketed and sorted by ``KEY``, so that no run shuffles it again.

    ``buckets``: the session's shuffle partitions unless given.  An earlier table of that name goes.
    """
    buckets = buckets or int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shuffled = findings.repartition(buckets, *KEY)
    shuffled.write.mode("overwrite").format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(table)


def diff_with_table(findings: DataFrame, table: str) -> DataFrame:
    """As ``baseline_diff`` with a table of ``save_baseline``; each side is read once, and only the new findings are shuffled.

    Both sides meet in one outer join by key.  The rows of a key on the table's side
    become one row before, in the bucket: a scan's findings of one code and signal, at most one a rule.
    Rows whose key holds a null are new or absent.
    """
    before = findings.sparkSession.table(table)
    columns = [f for f in findings.schema if f.name != "baseline_state"]
    have = set(before.columns)
    gone = F.struct(*((F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in columns if f.name != "pass"))
    before = before.groupBy(*KEY).agg(F.collect_list(gone).alias("_gone"))
    now = findings.select(*KEY, F.struct(*(f.name for f in columns)).alias("_now"))
    met = now.join(before.hint("merge"), KEY, "full")
    unchanged = F.when(F.col("_gone").isNull(), "new").otherwise("unchanged")
    here = F.array(F.struct(*(F.col(f"_now.{f.name}").alias(f.name) for f in columns), unchanged.alias("baseline_state")))
    absent = F.transform("_gone", lambda g: F.struct(*((F.lit(PASSES["absent"]).cast(f.dataType) if f.name == "pass" else g[f.name]).alias(f.name) for f in columns), F.lit("absent").alias("baseline_state")))
    return met.select(F.inline(F.when(F.col("_now").isNotNull(), here).otherwise(absent)))


def read_for_gap(spark: SparkSession, path: str) -> DataFrame:
    """Actions of a path: a file ``*.jsonl`` (any case) is a transcript, anything else a repository."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    is_file = store.exists(place) and store.getFileStatus(place).isFile()
    return read_sessions(spark, path).actions if is_file and path.lower().endswith(".jsonl") else read_repo(spark, path)
