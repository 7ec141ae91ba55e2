"""Chat records made into a training corpus in one pass: judged, split by candidate, routed to several sinks, counted while they are written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessella.functions import jsons, labels, rules, text
from tessella.operators.audit import split_name

# Least characters of a body and of an answer, reasons in the order in which they are found, and the task that needs a label.
LEAST_BODY, LEAST_ANSWER = 50, 15
REASONS = ("empty_line", "json_parse_error", "invalid_messages_structure", "missing_user_or_assistant_message", "resume_content_too_short", "assistant_response_too_short")
SPLITS = ("train", "validation", "test")
CLASSIFICATION = "resume_classification"


def judge_records(lines: DataFrame, key: str, line: str, tasks: Sequence[tuple[str, str]], other: str, patterns: Sequence[str], default: str) -> DataFrame:
    """(key, line, reason, instruction, body, answer, candidate_id, tasks, label, split) of one JSON record a line.

    ``reason`` is the first of ``REASONS`` that holds, else null; of a rejected record the rest is null.  The last
    message of each role counts.  Candidates are told apart by the hash of the whole body, and all their records fall in one split.
    """
    rows = lines.select(key, F.col(line).alias("line")).withColumn("v", F.try_parse_json(F.nullif(F.trim(F.coalesce("line", F.lit(""))), F.lit(""))))
    messages = F.when(jsons.kind(F.try_variant_get("v", "$.messages", "variant")) == "array", F.try_variant_get("v", "$.messages", "array<variant>"))
    rows = rows.withColumn("m", messages)

    def last(role: str) -> Column:
        said = F.filter("m", lambda x: F.coalesce(F.try_variant_get(x, "$.role", "string") == role, F.lit(False)))
        return F.coalesce(F.try_variant_get(F.try_element_at(said, F.lit(-1)), "$.content", "string"), F.lit(""))

    rows = rows.withColumns({"user": last("user"), "answer": last("assistant")})
    rows = rows.withColumn("s", rules.instruction_body(F.col("user"), patterns, default))
    checks = (
        F.trim(F.coalesce("line", F.lit(""))) == "", F.col("v").isNull(), F.coalesce(F.size("m") < 2, F.lit(True)), (F.col("user") == "") | (F.col("answer") == ""),
        F.length("s.body") < LEAST_BODY, F.length("answer") < LEAST_ANSWER,
    )
    reason = F.coalesce(*[F.when(c, r) for c, r in zip(checks, REASONS)])
    rows = rows.withColumn("reason", reason)
    good = lambda c: F.when(F.col("reason").isNull(), c)
    candidate = F.concat(F.lit("cand_"), F.substring(text.fingerprint(F.col("s.body")), 1, 12))
    out = rows.select(key, "line", "reason", good(F.col("s.instruction")).alias("instruction"), good(F.col("s.body")).alias("body"), good(F.col("answer")).alias("answer"), good(candidate).alias("candidate_id"), good(labels.all_matches(F.lower("user"), tasks, other)).alias("tasks"))
    label = F.when(F.array_contains("tasks", CLASSIFICATION), labels.category_label(F.col("answer")))
    return out.withColumn("label", label).withColumn("split", F.when(F.col("reason").isNull(), split_name(F.col("candidate_id"))))


def routed(judged: DataFrame, key: str) -> DataFrame:
    """(sink, value): the JSON text of each record for each sink that it goes to: accepted or rejected, its split, and its tasks; a classification needs a label."""
    whole = F.to_json(F.struct(F.col(key).alias("id"), "candidate_id", "tasks", "instruction", "body", "answer", "label", "split"))
    tasks = F.filter("tasks", lambda t: (t != CLASSIFICATION) | F.col("label").isNotNull())
    to = F.concat(F.array(F.lit("accepted"), F.concat(F.lit("split-"), "split")), F.transform(tasks, lambda t: F.concat(F.lit("task-"), t)))
    accepted = F.transform(to, lambda s: F.struct(s.alias("sink"), whole.alias("value")))
    refused = F.array(F.struct(F.lit("rejected").alias("sink"), F.to_json(F.struct(F.col(key).alias("id"), "reason", "line")).alias("value")))
    return judged.select(F.explode(F.when(F.col("reason").isNull(), accepted).otherwise(refused)).alias("x")).select("x.*")


def counted(judged: DataFrame, observation: Observation) -> DataFrame:
    """``judged`` with the figures of the report taken while its rows pass: all, accepted, rejected, each reason and each split."""
    figures = [F.count(F.lit(1)).alias("records"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected")]
    figures += [F.count_if(F.col("reason") == r).alias(r) for r in REASONS] + [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    return judged.observe(observation, *figures)


def prepare_corpus(judged: DataFrame, key: str, path: str) -> DataFrame:
    """Writes every sink under ``path`` (folders sink=...) and the report as JSON beside them, in one pass over the records; returns the report's row."""
    spark, observation = judged.sparkSession, Observation("preparation")
    routed(counted(judged, observation), key).write.partitionBy("sink").mode("overwrite").text(f"{path}/records")
    figures = observation.get
    names = ["records", "accepted", "rejected", *REASONS, *SPLITS]
    report = spark.createDataFrame([tuple(figures.get(n, 0) for n in names)], ", ".join(f"{n} long" for n in names))
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    return report
