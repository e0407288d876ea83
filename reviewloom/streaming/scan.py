"""Scan submissions as they land.  Stateless, so a stream and a table share the code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom.functions import rules
from reviewloom.operators import diffs
from reviewloom.operators.metrics import paste_path
from reviewloom.operators.routing import route
from reviewloom.operators.scan import findings_array


def scan_submissions(submissions: DataFrame) -> DataFrame:
    """Findings of code and diff submissions, in one pass over them."""
    routed = route(submissions).filter(F.col("kind").isin("code", "diff"))
    is_code = F.col("kind") == "code"
    pasted = F.array(
        F.struct(paste_path().alias("path"), F.lit(0).alias("file_ord"), F.col("code").alias("text"))
    )
    files = routed.select(
        "analysis_id", "kind", F.inline(F.when(is_code, pasted).otherwise(_diff_texts(F.col("diff"))))
    )

    either = F.when(
        is_code, findings_array("text", rules.CODE_SECURITY, rules.CODE_PERFORMANCE)
    ).otherwise(findings_array("text", rules.DIFF_SECURITY, rules.DIFF_PERFORMANCE))
    return files.select(
        "analysis_id", F.col("kind").alias("submission"), "path", "file_ord", F.inline(either)
    )


def _diff_texts(diff: Column) -> Column:
    """(path, file_ord, text) of the files of a diff, inside its row."""

    def one(block: Column, i: Column) -> Column:
        bodies = F.transform(diffs.hunks_array(block), lambda h: h["content"])
        return F.struct(
            diffs.path_of(block).alias("path"), i.cast("int").alias("file_ord"),
            F.array_join(bodies, "\n").alias("text"),
        )

    return F.transform(diffs.blocks_of(diff), one)


def start_scan(submissions: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append the findings of what has landed to a table, then stop."""
    return (
        scan_submissions(submissions)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
