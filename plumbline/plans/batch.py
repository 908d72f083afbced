"""Auditing a list of datasets, and rolling the results up."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Expired
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import AuditConfig
from plumbline.functions.columns import c
from plumbline.operators.models import MODEL_REGISTRY, model_type
from plumbline.operators.profile import collect_roles
from plumbline.operators.split import with_row_id
from plumbline.operators.target import pick_target
from plumbline.plans.audits import fairness_audit, profile_audit, quality_audit
from plumbline.session import materialise
from plumbline.sources.readers import extension, load_table, pick_file, table_files
from plumbline.sources.sinks import tidy

# Defaults of a manifest entry.
DEFAULT_TIMEOUT = 3600

# The column that tells the rows of a result apart.
ITEMS = {
    "overview": "metric", "column_types": "column_type", "columns": "col", "alerts": "col",
    "f1_report": None, "outlier_summary": None, "top_patterns": "pattern",
    "group_fairness": "sensitive_feature", "precision_by_group": "group", "influence_fairness": "positive_group",
}

ROW_ID = "_row_id"
CANCEL_ATTEMPTS = 120
STATUS_SCHEMA = "dataset string, part string, status string, detail string"


@dataclass(frozen=True)
class Entry:
    """One dataset of a manifest; without a file number a folder is one table."""

    location: str
    target: str
    file_number: int | None = None
    model: str = next(iter(MODEL_REGISTRY))
    timeout: int = DEFAULT_TIMEOUT
    platform: str = ""
    row_id: str | None = None


def read_manifest(text: str) -> tuple[list[Entry], list[tuple[str, str]]]:
    """Usable entries of a JSON manifest ``{location: settings}``, and the refused ones."""
    listed = json.loads(text)
    if not isinstance(listed, dict):
        raise ValueError("a manifest maps locations to settings")
    good, bad = [], []
    for location, settings in listed.items():
        target = str(settings.get("target_column", "")).strip()
        model = str(settings.get("model_type", next(iter(MODEL_REGISTRY)))).strip()
        if not location or not target:
            bad.append((location, "missing required fields"))
        elif model not in MODEL_REGISTRY:
            bad.append((location, f"invalid model {model!r}"))
        else:
            number = settings.get("no_dataset")
            good.append(Entry(
                location, target, None if number is None else int(number), model,
                int(settings.get("timeout", DEFAULT_TIMEOUT)), str(settings.get("platform", "")),
                settings.get("row_id"),
            ))
    return good, bad


def run_with_limit(spark: SparkSession, seconds: float, work: Callable[[], object]) -> object:
    """Run ``work`` with a time limit; its Spark jobs are cancelled when it is over."""
    tag = f"audit-{uuid.uuid4().hex}"
    box: dict[str, object] = {}

    def tagged() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            box["value"] = work()
        except BaseException as error:  # handed to the caller below
            box["error"] = error
        finally:
            spark.sparkContext.removeJobTag(tag)

    thread = threading.Thread(target=inheritable_thread_target(spark)(tagged), daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        # The thread may be between two jobs, so cancelling goes on until one fails it.
        for _ in range(CANCEL_ATTEMPTS):
            spark.sparkContext.cancelJobsWithTag(tag)
            thread.join(0.5)
            if not thread.is_alive():
                break
        raise Expired(f"not done after {seconds:g} seconds")
    if "error" in box:
        raise box["error"]
    return box["value"]


def audit_dataset(
    spark: SparkSession, entry: Entry, cfg: AuditConfig = AuditConfig(),
    load: Callable[[SparkSession, Entry], DataFrame] | None = None,
) -> tuple[DataFrame | None, list[tuple[str, str, str, str]]]:
    """All audits of one dataset as a tidy report, and what came of each part.

    Quality and fairness run side by side on the same cluster within one time limit; a part
    that fails or runs out of time is recorded and does not stop the other.
    """
    status: list[tuple[str, str, str, str]] = []
    try:
        df = load(spark, entry) if load else _load(spark, entry)
        body = df.drop(entry.row_id) if entry.row_id else df
        profile = profile_audit(body)
        pick_target(body, collect_roles(body), entry.target)
        table = with_row_id(df, [entry.row_id] if entry.row_id else None, ROW_ID)
        if entry.row_id:
            table = table.drop(entry.row_id)
    except Exception as error:
        return None, [(entry.location, "load", "failed", _short(error))]
    kind = model_type(entry.model)
    parts = {
        "profile": lambda: profile,
        "quality": lambda: quality_audit(table, ROW_ID, entry.target, kind, cfg),
        "fairness": lambda: fairness_audit(table, ROW_ID, entry.target, kind, cfg),
    }

    def one(name: str) -> DataFrame | None:
        def work() -> DataFrame:
            found = [tidy(k, v, ITEMS[k]) for k, v in parts[name]().items()]
            return materialise(reduce(DataFrame.unionByName, found), f"report_{name}")

        try:
            done = run_with_limit(spark, entry.timeout, work)
            status.append((entry.location, name, "done", ""))
            return done
        except Expired as error:
            status.append((entry.location, name, "timeout", str(error)))
        except Exception as error:
            status.append((entry.location, name, "failed", _short(error)))
        return None

    with ThreadPoolExecutor(len(parts)) as pool:
        done = pool.map(inheritable_thread_target(spark)(one), parts)
        reports = [r for r in done if r is not None]
    if not reports:
        return None, status
    report = reduce(DataFrame.unionByName, reports)
    return report.select(F.lit(entry.location).alias("dataset"), F.lit(entry.platform).alias("platform"), "*"), status


def _load(spark: SparkSession, entry: Entry) -> DataFrame:
    """The dataset; text formats are parsed once and kept as Parquet for the many passes."""
    number = entry.file_number
    files = table_files(spark, entry.location)[0] if number is None else [pick_file(spark, entry.location, number)]
    df = load_table(spark, entry.location, number=number)
    return df if extension(files[0]) == ".parquet" else materialise(df, "input")


def _short(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}".splitlines()[0][:500]


def batch_audit(
    spark: SparkSession, entries: list[Entry], cfg: AuditConfig = AuditConfig(),
    refused: list[tuple[str, str]] = (), load=None, at_once: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Audit every entry; returns the joined report and a status table.

    A few datasets run at a time from driver threads; their jobs share the executors.
    """
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        results = list(pool.map(
            inheritable_thread_target(spark)(lambda e: audit_dataset(spark, e, cfg, load)), entries))
    reports = [r for r, _ in results if r is not None]
    empty = spark.createDataFrame(
        [], "dataset string, platform string, section string, item string, metric string, value string")
    rows = [s for _, found in results for s in found] + [(loc, "manifest", "refused", why) for loc, why in refused]
    return reduce(DataFrame.unionByName, reports, empty), spark.createDataFrame(rows, STATUS_SCHEMA)


def roll_up(report: DataFrame) -> DataFrame:
    """What the audits of many datasets say together, per platform and overall.

    Shares of datasets in which either trimming gives the best F1 or both tie, mean F1
    changes, mean overlap of the outlier sets, and shares of unfair columns and subgroups.
    """

    def value(section: str, metric: str):
        mine = (c("section") == section) & (c("metric") == metric)
        return F.max(F.when(mine, c("value").try_cast("double")))

    def unfair(section: str, metrics: list[str]):
        mine = (c("section") == section) & c("metric").isin(*metrics)
        return F.count_if(mine & (c("value") == "false")), F.count_if(mine)

    gaps, all_gaps = unfair("group_fairness", ["DPD_fair", "EOD_fair", "PPV_fair"])
    infl, all_infl = unfair("influence_fairness", ["inf_fair"])
    cohen, all_cohen = unfair("influence_fairness", ["cohen_fair"])
    per = report.groupBy("platform", "dataset").agg(
        value("f1_report", "f1_orig").alias("f0"), value("f1_report", "f1_statistic").alias("fs"),
        value("f1_report", "f1_influence").alias("fi"),
        value("outlier_summary", "overlap_count").alias("overlap"),
        value("outlier_summary", "influence_outliers_count").alias("ni"),
        value("outlier_summary", "mahalanobis_outliers_count").alias("nm"),
        gaps.alias("gaps"), all_gaps.alias("all_gaps"), infl.alias("infl"), all_infl.alias("all_infl"),
        cohen.alias("cohen"), all_cohen.alias("all_cohen"),
    )

    def pct(flag):
        return F.try_divide(F.count_if(flag) * 100.0, F.count(c("f0")))

    either = c("ni") + c("nm") - c("overlap")
    return per.rollup("platform").agg(
        F.count(F.lit(1)).alias("datasets"),
        pct(c("fs") > c("fi")).alias("statistic_best_pct"),
        pct(c("fi") > c("fs")).alias("influence_best_pct"),
        pct(c("fi") == c("fs")).alias("equal_pct"),
        F.avg((c("fs") - c("f0")) * 100).alias("statistic_f1_change"),
        F.avg((c("fi") - c("f0")) * 100).alias("influence_f1_change"),
        F.avg(F.try_divide(c("overlap") * 100.0, either)).alias("overlap_pct"),
        F.try_divide(F.sum("gaps") * 100.0, F.sum("all_gaps")).alias("unfair_columns_pct"),
        F.try_divide(F.sum("infl") * 100.0, F.sum("all_infl")).alias("unfair_subgroups_pct"),
        F.try_divide(F.sum("cohen") * 100.0, F.sum("all_cohen")).alias("cohen_unfair_pct"),
    )
