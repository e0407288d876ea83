"""Score submissions as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom.operators.routing import route
from reviewloom.plans.analyses import results_code, results_diff
from reviewloom.sources import store


def batch_results(submissions: DataFrame) -> DataFrame:
    """Results of the code and diff submissions of one batch."""
    routed = route(submissions)
    code = routed.filter(F.col("kind") == "code").select("analysis_id", "code", "filename")
    diff = routed.filter(F.col("kind") == "diff").select("analysis_id", "diff")
    return results_code(code).unionByName(results_diff(diff))


def start_results(submissions: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Write the results of what has landed, then stop.  A batch run again replaces itself.

    An id that comes again is written again; ``store.load`` gives its last result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.save(batch_results(batch), sink, batch_id)

    return (
        submissions.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
