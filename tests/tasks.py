"""Tasks, evaluators and models that the command line's tests name."""

from pyspark.sql import functions as F

from tracelake.operators.experiments import Evaluator


def echo(case):
    return case["input"] or ""


def fails(case):
    raise RuntimeError("no")


def _short(rows):
    ok = F.length("output") < 10
    return rows.select("case_pos", F.lit(0).alias("row_pos"), ok.cast("double").alias("score"), ok.alias("test_pass"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("label"))


SHORT = Evaluator("short", _short)


def detector(prompts):
    hit = F.contains("prompt", F.lit('"tool":"error"'))
    body = '{"errors":[{"location":"1","category":["bad"],"confidence":["high"],"evidence":["e"]}]}'
    return prompts.withColumn("response", F.when(hit, F.lit(body)).otherwise(F.lit('{"errors":[]}')))


def analyst(prompts):
    return prompts.withColumn("response", F.lit('{"root_causes":[{"failure_span_id":"1","location":"l","fix_recommendation":{"fix_type":"f","recommendation":"mend it"}}]}'))
