"""The report job: reports written as files, with their catalogue and audit rows."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.utils import AnalysisException

from shelfmart import schemas
from shelfmart.functions.coerce import printable, sanitise, with_headers
from shelfmart.operators.constants import fixed_table
from shelfmart.plans import reports
from shelfmart.plans.mart import Mart
from shelfmart.storage import TableStore

# Spreadsheet text, page text, and Spark's own formats.
CSV, PAGE, PARQUET = "csv", "page", "parquet"

GENERATE = "generate_report"
REPORT_LOG = "report_log"
REPORT_RUN = (
    "position int, report_type string, format string, parameters string, file_path string, rows long, "
    "generated_at timestamp_ntz, generated_by int, schedule string, resource string, detail string"
)
AT_ONCE = 4


@dataclass(frozen=True)
class Request:
    report_type: str
    first: dt.date
    last: dt.date
    format: str = PARQUET
    channel_id: int | None = None
    category_id: int | None = None


def write_report(report: DataFrame, path: str, format: str) -> int:
    """Write a report, an empty one too, and return its rows, counted while they are written. A path written before is
    replaced."""
    seen = Observation()
    report = report.observe(seen, F.count("*").alias("rows"))
    if format == CSV:
        with_headers(report).write.mode("overwrite").option("header", True).csv(path)
    elif format == PAGE:
        printable(report).write.mode("overwrite").option("header", True).csv(path)
    else:
        report.write.mode("overwrite").format(format).save(path)
    return seen.get["rows"]


def run_reports(
    store: TableStore,
    mart: Mart,
    requests: Sequence[Request],
    as_of: dt.datetime,
    run_id: str,
    user_id: int | None = None,
    schedule: str | None = None,
) -> DataFrame:
    """Write the requested reports, some at a time, and log them; the rows of the log are returned.

    A run has one log entry, which holds what the catalogue and the audit show of all its reports. The entry is written
    last and under the id of the run, so that a run that is repeated replaces its files and its entry.
    """
    frames = [
        reports.report(r.report_type, mart, r.first, r.last, as_of, r.channel_id, r.category_id) for r in requests
    ]
    paths = [f"{store.root}/reports/{run_id}/{n}-{r.report_type}.{r.format}" for n, r in enumerate(requests, start=1)]

    def write(job) -> int:
        request, frame, path = job
        return write_report(sanitise(frame) if request.format == PARQUET else frame, path, request.format)

    with ThreadPoolExecutor(AT_ONCE) as pool:
        counts = list(pool.map(write, zip(requests, frames, paths, strict=True)))
    rows = [
        (n, r.report_type, r.format, _parameters(r), path, count, as_of, user_id, schedule, f"report:{r.report_type}", _detail(r))
        for n, (r, path, count) in enumerate(zip(requests, paths, counts, strict=True), start=1)
    ]
    log = fixed_table(store.spark, rows, REPORT_RUN)
    log.coalesce(1).write.mode("overwrite").parquet(f"{store.root}/{REPORT_LOG}/run_id={run_id}")
    return log


def _parameters(request: Request) -> str:
    return json.dumps(
        {
            "from_date": request.first.isoformat(),
            "to_date": request.last.isoformat(),
            "channel_id": request.channel_id,
            "category_id": request.category_id,
        }
    )


def _detail(request: Request) -> str:
    return json.dumps({"format": request.format, "from": request.first.isoformat(), "to": request.last.isoformat()})


def report_log(store: TableStore) -> DataFrame:
    schema = f"{REPORT_RUN}, run_id string"
    try:
        return store.spark.read.schema(schema).parquet(f"{store.root}/{REPORT_LOG}")
    except AnalysisException:
        return store.spark.createDataFrame([], schema)


def catalogue(store: TableStore) -> DataFrame:
    """Reports that were generated, in the form of `schemas.REPORT_CATALOGUE`."""
    columns = [c.split()[0] for c in schemas.REPORT_CATALOGUE.split(", ")]
    return report_log(store).withColumn("report_id", F.xxhash64("run_id", "position")).select(*columns)


def audit(store: TableStore) -> DataFrame:
    """The same runs as actions of their users, in the form of `schemas.AUDIT_LOG`."""
    return report_log(store).select(
        F.xxhash64("run_id", "position", F.lit("audit")).alias("log_id"),
        F.col("generated_by").cast("long").alias("user_id"),
        F.lit(GENERATE).alias("action"),
        "resource",
        F.lit(None).cast("string").alias("ip_address"),
        "detail",
        F.col("generated_at").alias("created_at"),
    )
