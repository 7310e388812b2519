"""Experiments, reports, cached results and metric records as files, and session sources with pushed filters."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CASES = (
    "name string, session_id string, input string, expected_output string, expected_assertion string, expected_trajectory array<string>, metadata map<string,string>"
)
#: Names that metric records must have for their readers (format, fixed values).
METRIC_HEAD, METRIC_LIST = "_aws", "CloudWatchMetrics"
REPORT = "evaluator string, case_name string, score double, test_pass boolean, reason string, applicable boolean"


def _json_only(path: str) -> str:
    if not path.endswith(".json"):
        raise ValueError("only .json files are supported")
    return path


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an experiment file ``{"cases": [...], "evaluators": [...]}``; a missing session id is made of the name."""
    text = spark.read.text(_json_only(path), wholetext=True)
    cases = text.select(F.posexplode(F.from_json("value", f"cases array<struct<{CASES.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>")["cases"]).alias("case_pos", "c"))
    return cases.select("case_pos", "c.*").withColumn("session_id", F.coalesce("session_id", F.sha2(F.concat_ws("/", "name", F.col("case_pos").cast("string")), 256)))


def read_evaluators(spark: SparkSession, path: str) -> list[dict]:
    """Evaluator specifications, a few per experiment; ``model_id`` is the older name of ``model``."""
    body = json.loads(spark.read.text(_json_only(path), wholetext=True).first()["value"])
    return [{("model" if k == "model_id" else k): v for k, v in e.items()} for e in body.get("evaluators", [])]


def write_report(report: DataFrame, path: str) -> None:
    report.select(*[c.split()[0] for c in REPORT.split(", ")]).write.mode("overwrite").json(_json_only(path))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(_json_only(path))


def write_experiment(cases: DataFrame, evaluators: list[dict], path: str) -> None:
    """An experiment file: its cases in order and its evaluators' specifications, as one JSON file. Experiments are made
    by hand or from a model's answers, so one file holds them."""
    rows = cases.orderBy("case_pos").select(*[c.split()[0] for c in CASES.split(", ")]).toJSON().collect()
    write_text(cases.sparkSession, _json_only(path), json.dumps({"cases": [json.loads(r) for r in rows], "evaluators": evaluators}, indent=2, ensure_ascii=False))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any file system, through the driver's Hadoop classes."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def write_report_file(report: DataFrame, path: str) -> None:
    """A report as one file of JSON lines in order; reports of millions of rows go to folders (``write_report``)."""
    rows = report.orderBy("evaluator", "case_name").select(*[c.split()[0] for c in REPORT.split(", ")]).toJSON().collect()
    write_text(report.sparkSession, _json_only(path), "\n".join(rows))


class ResultCache:
    """Task results by case name, as a Parquet table; cases that it holds are not run again. Of a name that was saved more
    than once the last one counts."""

    def __init__(self, spark: SparkSession, path: str, key: str = "case_name") -> None:
        self.spark, self.path, self.key = spark, path, key

    def load(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        if not there:
            return None
        rows = self.spark.read.parquet(self.path)
        last = Window.partitionBy(self.key).orderBy(F.col("__saved").desc())
        return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__saved")

    def one(self, name: str) -> DataFrame | None:
        """The result of one case; the filter reaches the files."""
        known = self.load()
        return None if known is None else known.where(F.col(self.key) == name)

    def missing(self, cases: DataFrame) -> DataFrame:
        known = self.load()
        return cases if known is None else cases.join(known.select(self.key), self.key, "left_anti")

    def save(self, results: DataFrame) -> None:
        results.withColumn("__saved", F.lit(time.time_ns())).write.mode("append").parquet(self.path)


def write_metrics(report: DataFrame, path: str, namespace: str = "evaluations") -> None:
    """Metric records as JSON lines, one per set of dimensions, with their names listed as metric services expect it."""
    dimensions = F.array_compact(F.array(F.when(F.col("evaluator").isNotNull(), F.lit("evaluator")), F.when(F.col("case_name").isNotNull(), F.lit("case_name"))))
    metric = lambda name: F.struct(F.lit(name).alias("Name"))
    directive = F.struct(F.lit(namespace).alias("Namespace"), F.array(dimensions).alias("Dimensions"), F.array(*map(metric, ("score", "passed", "n"))).alias("Metrics"))
    head = F.struct((F.unix_millis(F.current_timestamp())).alias("Timestamp"), F.array(directive).alias(METRIC_LIST))
    metric_records(report).select(head.alias(METRIC_HEAD), "evaluator", "case_name", "score", "passed", "n").write.mode("append").json(path)


def metric_records(report: DataFrame) -> DataFrame:
    """One record per evaluator result under four sets of dimensions, as grouping sets of one pass."""
    sets = [("evaluator", "case_name"), ("evaluator",), ("case_name",), ()]
    out = report.groupingSets([[F.col(c) for c in s] for s in sets], "evaluator", "case_name").agg(F.avg("score").alias("score"), F.count_if("test_pass").alias("passed"), F.count("*").alias("n"))
    return out


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines dump of a log store, of any size and on any file system: session_id, and record as it
    stands. The id is parsed from each line, so a filter on it sees what the record says, however it is written."""
    lines = spark.read.text(path).where("value <> ''")
    return lines.select(F.get_json_object("value", "$.session_id").alias("session_id"), F.col("value").alias("record"))


def lookup(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each case with its session's outputs; ``found`` is false for sessions that a source does not have."""
    return cases.join(outputs.withColumn("found", F.lit(True)), "session_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def image_bytes(source: Column) -> Column:
    """Bytes of an image given as a data URL or as base64 text; null for others."""
    data = F.regexp_extract(source, r"^data:[^,]*;base64,(.*)$", 1)
    text = F.coalesce(F.nullif(data, F.lit("")), source)
    return F.when(text.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(text) % 4 == 0), F.unbase64(text))


def image_kind(source: Column) -> Column:
    """How an image is given: ``data`` (a data URL), ``url``, ``path`` or ``base64``."""
    is_path = source.rlike(r"(?i)^(?:file:|hdfs:|s3a?:|/|\./|\.\./|[A-Za-z]:\\)") | source.rlike(r"(?i)\.(?:png|jpe?g|gif|webp|bmp)$")
    return F.when(source.rlike("^data:"), "data").when(source.rlike("(?i)^https?://"), "url").when(is_path, "path").otherwise("base64")


def resolve_images(images: DataFrame, source: str = "source") -> DataFrame:
    """Rows with ``bytes``: data URLs and base64 texts are decoded in place, paths are read by Spark's ``binaryFile``
    reader; what cannot be had (addresses on the net among them) has ``error``."""
    spark = images.sparkSession
    marked = images.withColumn("kind", image_kind(F.col(source)))
    paths = [r[0] for r in marked.where("kind = 'path'").select(source).distinct().limit(1001).collect()]
    if len(paths) > 1000:
        raise ValueError("more than 1,000 image files: read their folder with binaryFile and join it on the path")
    here = marked.where("kind <> 'path'").withColumn("bytes", F.when(F.col("kind").isin("data", "base64"), image_bytes(F.col(source))))
    out = here
    if paths:
        files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("__path"), F.col("content").alias("bytes"))
        there = marked.where("kind = 'path'").withColumn("__path", F.regexp_replace(source, "^file:/*", "/")).join(files, "__path", "left").drop("__path")
        out = here.unionByName(there)
    return out.withColumn("error", F.when(F.col("bytes").isNull(), F.concat(F.lit("no image from a "), "kind")))
