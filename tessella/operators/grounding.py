"""Proposed values held against the text they claim to come from: grounded or not, supported or only wished for, taken or refused."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import rules

# Words of a value that are looked for, characters that are enough, a start that is a link,
# characters by which a longer text replaces one, its checked start and end, and words that end belongs to other sections by.
FINGERPRINT, ENOUGH = 3, 3
LINK = r"^https?://"
LONGER_BY, START, TAIL = 20, 50, 40
STRAY = r"(?i)\b(?:SPSS|Tally|Education|Skills|Languages|Declaration)\b"
#: How a field is taken: wherever it is missing; missing and grounded; missing and a link; grounded and clearly longer than what is there.
ANY, GROUNDED, LINKED, LONGER = "any", "grounded", "link", "longer"


def is_grounded(value: Column, low_text: Column) -> Column:
    """Whether a value stands in a lower-cased text: whole, where it has one or two words, else its first three words or its first three characters."""
    low = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", ""))
    words = F.split(low, r"\s+")
    few = F.size(words) <= 2
    found = F.when(few, low_text.contains(low)).otherwise(low_text.contains(F.array_join(F.slice(words, 1, FINGERPRINT), " ")) | low_text.contains(F.substring(low, 1, ENOUGH)))
    return F.coalesce((low != "") & (low_text != "") & found, F.lit(False))


def _beside_text(docs: DataFrame, proposed: DataFrame, key: str, text: str, columns: list[str]) -> DataFrame:
    """Each document once, with the array ``p`` of all that is proposed for it: a text is never repeated for its values."""
    listed = proposed.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("p"))
    return listed.join(docs.select(key, F.col(text).alias("t")), key, "left").withColumn("t", F.coalesce("t", F.lit("")))


def resolve_fields(docs: DataFrame, held: DataFrame, proposed: DataFrame, key: str, text: str, policies: Mapping[str, str]) -> DataFrame:
    """(key, field, value, decision) of every proposed value that is not blank.

    held and proposed: (key, field, value), a field once for each key.  What is held wins, but for fields of the policy ``longer``.
    decision: accepted, held, not grounded, no link, not longer, or stray end (the end reads like another section).
    """
    own = held.select(key, "field", F.nullif(F.trim("value"), F.lit("")).alias("own")).where("own IS NOT NULL")
    asked = proposed.select(key, "field", F.trim("value").alias("value")).where("value <> ''").join(own, [key, "field"], "left")
    rows = _beside_text(docs, asked, key, text, ["field", "value", "own"])
    policy = F.create_map(*[F.lit(x) for pair in policies.items() for x in pair])

    def decided(p: Column, low_text: Column) -> Column:
        how = F.coalesce(F.try_element_at(policy, p["field"]), F.lit(ANY))
        starts = is_grounded(F.when(how == LONGER, F.substring(p["value"], 1, START)).otherwise(p["value"]), low_text)
        short = p["own"].isNotNull() & (F.length(p["value"]) <= F.length(p["own"]) + LONGER_BY)
        return (
            F.when((how == LONGER) & short, "not longer")
            .when((how != LONGER) & p["own"].isNotNull(), "held")
            .when((how == LINKED) & ~p["value"].rlike(LINK), "no link")
            .when((how == LONGER) & F.right(p["value"], F.lit(TAIL)).rlike(STRAY), "stray end")
            .when(how.isin(GROUNDED, LONGER) & ~starts, "not grounded")
            .otherwise("accepted")
        )

    judged = rows.withColumn("low", F.lower("t")).select(key, F.explode(F.transform("p", lambda p: F.struct(p["field"].alias("field"), p["value"].alias("value"), decided(p, F.col("low")).alias("decision")))).alias("d"))
    return judged.select(key, "d.*")


def supported_skills(docs: DataFrame, proposed: DataFrame, key: str, text: str) -> DataFrame:
    """(key, skill, n_mentions, n_plain, supported) of proposed (key, skill).

    A mention is a line with the skill as a whole word; a skill is supported unless all its lines only wish
    for it or deny it.  Without a text or a mention it is supported.
    """
    rows = _beside_text(docs, proposed.select(key, "skill").where("skill IS NOT NULL").distinct(), key, text, ["skill"])
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    said = rows.withColumn("lines", F.transform(lines, lambda x: F.struct(F.lower(x).alias("low"), rules.sentence_class(x).isin("aspiration", "negated").alias("wished"))))

    def counted(p: Column) -> Column:
        word = F.concat(F.lit(r"(?<![a-zA-Z0-9_])\Q"), F.lower(p["skill"]), F.lit(r"\E(?![a-zA-Z0-9_])"))
        named = F.filter("lines", lambda x: F.regexp_like(x["low"], word))
        return F.struct(p["skill"].alias("skill"), F.size(named).alias("n_mentions"), F.size(F.filter(named, lambda x: ~x["wished"])).alias("n_plain"))

    out = said.select(key, F.explode(F.transform("p", counted)).alias("c")).select(key, "c.*")
    return out.withColumn("supported", (F.col("n_mentions") == 0) | (F.col("n_plain") > 0))
