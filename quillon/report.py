"""The evaluation report: python -m quillon.report INDEX VALIDATION prints one JSON object."""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.features import features
from .operators import cells, evaluate, knn, search
from .operators.shared import scoped, written
from .sources.payload import decoded
from .sources.references import load_validation


@scoped
def report(spark: SparkSession, index: str, validation: str, first: int = 16, most: int = 64, runs: int = 3) -> dict:
    """Mismatches, confusion, probes, pruning and seconds of a saved index over a validation file.

    seconds are those of whole adaptive searches over all requests, one for each run.
    """
    members, boxed = cells.load(spark, index)
    asked = load_validation(spark, validation)
    read = written(features(decoded(asked.select("qid", "payload"))).select("qid", "parse_ok", "v"), "requests")
    queries = read.where("parse_ok").select("qid", "v")
    took = []
    for _ in range(runs):
        began = time.monotonic()
        done = written(search.adaptive(queries, members, boxed, first, most), "decisions")
        took.append((time.monotonic() - began,))
    answers = knn.safe(read, done).select("qid", "parse_ok", "approved")
    results = written(answers.join(asked.select("qid", "expected_approved", F.col("expected_fraud_score").alias("expected_score")), "qid"), "results")

    def row(df: DataFrame) -> dict:
        return df.first().asDict()

    pruned = row(search.pruning(queries, members, boxed))
    return {
        **row(evaluate.mismatches(results)),
        **row(evaluate.confusion(results)),
        "probes": row(evaluate.percentiles(done, "probes")),
        "seconds": row(evaluate.percentiles(spark.createDataFrame(took, "seconds double"), "seconds")),
        "pruned_share": 1 - pruned["read"] / pruned["every"] if pruned["every"] else None,
    }


if __name__ == "__main__":
    from .session import session

    print(json.dumps(report(session("report"), *sys.argv[1:3])))
