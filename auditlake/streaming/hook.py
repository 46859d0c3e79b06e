"""Verdicts on calls before they run, as a table and as the sink of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlake.plans.detect import detect
from auditlake.plans.pack import Config, RulePack, SuppressRule
from auditlake.sources.repo import literal_actions


def hook_verdicts(calls: DataFrame, pack: RulePack, suppress: list[SuppressRule] = (), config: Config = Config(), block: bool = False) -> DataFrame:
    """``call, verdict, exit_code, codes`` for each call (``call``: its id, ``command``).

    A call with an active candidate is warned of, or blocked where ``block`` is on (exit code 2); all others
    pass, those without a command as well.  Each call is a scan of its own, so rules on several actions don't apply.  Calls that share an id are one.
    """
    found = detect(literal_actions(calls, "call", "command"), pack, suppress, config).findings
    codes = found.groupBy("scan_id").agg(F.array_sort(F.collect_set("id")).alias("codes"))  # at most a pack's codes
    ids = calls.select(F.col("call").cast("string").alias("call")).distinct()
    rows = ids.join(codes, F.col("call") == F.col("scan_id"), "left")
    hit = F.col("codes").isNotNull()
    verdict = F.when(~hit, "pass").otherwise("block" if block else "warn")
    return rows.select("call", verdict.alias("verdict"), F.when(hit, 2 if block else 0).otherwise(0).alias("exit_code"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def batch_writer(path: str, verdicts: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Writes the verdicts of a micro-batch as ``path/batch=N``, once.

    The folders are the ledger: a batch that is complete there is passed over when it comes again, one that broke off
    is written anew, so that a verdict stands once and is never taken back.
    """
    root = path.rstrip("/")

    def write(rows: DataFrame, number: int) -> None:
        spark, target = rows.sparkSession, f"{root}/batch={number:012d}"
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            verdicts(rows).write.mode("overwrite").parquet(target)

    return write


def write_verdicts(calls: DataFrame, path: str, checkpoint: str, pack: RulePack, suppress: list[SuppressRule] = (), config: Config = Config(), block: bool = False) -> StreamingQuery:
    """Starts a stream of verdicts on ``calls`` (``call, command``) into the table ``path``."""
    write = batch_writer(path, lambda rows: hook_verdicts(rows, pack, suppress, config, block))
    return calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
