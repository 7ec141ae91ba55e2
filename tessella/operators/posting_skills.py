"""Skills that a posting names, split into required and preferred by where the preferred part begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What opens the preferred part, marks that separate words, and aliases that are plain words.
PREFERRED = r"preferred|nice\s*to\s*have|good\s*to\s*have|bonus|optional\s*skills"
SEPARATORS = r"[,;:\(\)\[\]\{\}\-\/\|\*\•]"
PLAIN_WORDS = ("for", "in", "to", "at", "as", "by", "or", "an", "on", "is", "it")


def _words(text: Column) -> Column:
    """Words of a lower-case text, with symbols inside (c++, node.js), without full stops and quotes around them and without 's."""
    parts = F.split(F.regexp_replace(text, SEPARATORS, " "), r"\s+")
    return F.filter(F.transform(parts, lambda w: F.regexp_replace(F.regexp_replace(w, r"^['\".!?]+|['\".!?]+$", ""), r"'s$", "")), lambda w: w != "")


def _spans(words: Column, longest: int) -> Column:
    """Runs of up to ``longest`` words."""
    each = []
    for n in range(1, longest + 1):
        last = F.size(words) - n + 1
        made = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), _span_at(words, n))
        each.append(F.when(last > 0, made).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*each))


def _span_at(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def posting_skills(postings: DataFrame, key: str, text: str, aliases: DataFrame, longest: int = 3) -> DataFrame:
    """(key, skill, tier) of each known skill in a posting; aliases: (alias, canonical), of any size.

    A name found in the preferred part, from the first word of ``PREFERRED`` to the end, is preferred, one found only before
    it required; a skill that some name makes required is not preferred.  Aliases of one character and plain words are
    not looked for.  Each part is cut into runs of words once, and the runs meet the aliases in an equi-join before anything is counted.
    """
    low = F.lower(F.translate(F.coalesce(F.col(text), F.lit("")), "’‘`“”", "'''\"\""))
    rows = postings.select(key, low.alias("t")).withColumn("at", F.regexp_instr("t", F.lit(PREFERRED)))
    before = F.when(F.col("at") > 0, F.expr("substring(t, 1, at - 1)")).otherwise(F.col("t"))
    after = F.when(F.col("at") > 0, F.expr("substring(t, at)")).otherwise(F.lit(""))
    parts = rows.select(key, F.explode(F.array(F.struct(F.lit(False).alias("late"), _words(before).alias("w")), F.struct(F.lit(True).alias("late"), _words(after).alias("w")))).alias("p"))
    terms = parts.select(key, "p.late", F.explode(_spans(F.col("p.w"), longest)).alias("term"))
    listed = aliases.where((F.length("alias") >= 2) & ~F.lower("alias").isin(*PLAIN_WORDS))
    known = listed.select(F.array_join(_words(F.lower("alias")), " ").alias("term"), "canonical").where("term <> ''").distinct()
    named = terms.join(known, "term").groupBy(key, "canonical", "term").agg(F.bool_or("late").alias("late"))
    found = named.groupBy(key, F.col("canonical").alias("skill")).agg(F.bool_and("late").alias("late"))
    return found.select(key, "skill", F.when(F.col("late"), "preferred").otherwise("required").alias("tier"))
