"""The corpus preparation: each reason, and figures that agree with what the sinks hold."""

import json

from tessella.operators import preparation as p

BODY = "A body of more than fifty characters, with several words in it. "
TASKS = (("summar", "resume_summary"), ("category", p.CLASSIFICATION))


def record(user=None, answer=None, **more):
    said = [{"role": r, "content": c} for r, c in (("user", user), ("assistant", answer)) if c is not None]
    return json.dumps({"messages": said} | more)


LINES = [
    " ", None, "{bad", "[]", '{"messages": []}', record("Summarize:\n" + BODY), record("Summarize:\n" + BODY, ""), record("Summarize:\nshort", "an answer that is long enough"),
    record("Summarize:\n" + BODY, "short"), record("Summarize:\n" + BODY, "an answer that is long enough"), record("Which category?\n" + BODY, "This best fits the SALES category."),
    record("Which category?\n" + BODY + "x", "I do not know which one it is"), record("Something\n" + BODY + "y", "an answer that is long enough"),
]


def judged(spark):
    return p.judge_records(spark.createDataFrame(list(enumerate(LINES)), "id int, line string"), "id", "line", TASKS, "other", [], "Read this")


def test_reasons_and_tasks(spark):
    got = {r["id"]: r for r in judged(spark).collect()}
    assert [got[i].reason for i in range(9)] == ["empty_line", "empty_line", "json_parse_error", "invalid_messages_structure", "invalid_messages_structure", "invalid_messages_structure", "missing_user_or_assistant_message", "resume_content_too_short", "assistant_response_too_short"]
    assert [(got[i].reason, got[i].tasks, got[i].label) for i in range(9, 13)] == [(None, ["resume_summary"], None), (None, [p.CLASSIFICATION], "SALES"), (None, [p.CLASSIFICATION], None), (None, ["other"], None)]
    assert got[9].candidate_id == got[10].candidate_id != got[11].candidate_id and got[9].split == got[10].split and got[9].instruction == "Summarize" and got[0].candidate_id is None


def test_figures_agree_with_the_sinks(spark, tmp_path):
    report = p.prepare_corpus(judged(spark), "id", str(tmp_path)).first()
    held = {r["sink"]: r["count"] for r in spark.read.text(f"{tmp_path}/records").groupBy("sink").count().collect()}
    assert (report.records, report.accepted, report.rejected) == (13, held["accepted"], held["rejected"]) == (13, 4, 9)
    assert {s: report[s] for s in p.SPLITS if report[s]} == {k[6:]: v for k, v in held.items() if k.startswith("split-")} and report.empty_line == 2
    assert {k[5:]: v for k, v in held.items() if k.startswith("task-")} == {"resume_summary": 1, p.CLASSIFICATION: 1, "other": 1}  # without a label no classification
    written = spark.read.json(f"{tmp_path}/report").first()
    assert written["rejected"] == 9 and sum(written[r] for r in p.REASONS) == 9
    assert p.prepare_corpus(judged(spark).where("false"), "id", f"{tmp_path}/none").first().records == 0
