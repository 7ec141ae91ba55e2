"""Small rules on text columns: sentence classes, atomic skills, instruction and body, proficiency, completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a sentence says about a skill.
ASPIRATION = (
    r"\b(want|aspire|wish|hope|aim|plan|seeking|looking|interested|eager|intent|strive)\s+(to\s+become|to\s+learn|to\s+work|for\s+opportunities|to\s+gain|for\s+a\s+role|for\s+a\s+position|to\s+pursue)\b",
    r"\b(looking\s+for|seeking)\s+(a|an|the|entry\s+level|junior|intern|developer|engineer|opportunities\s+in|role\s+in|position\s+in)\b",
    r"\b(career\s+goal|career\s+objective|objective|goal\s+is\s+to|aspiring|future|target\s+role|desired\s+role|desired\s+position)\b",
    r"\b(looking\s+forward\s+to\s+learning|want\s+to\s+learn|currently\s+planning\s+to\s+learn|interested\s+in\s+learning)\b",
)
NEGATED = (
    r"\b(did\s+not\s+work\s+with|never\s+used|not\s+worked\s+on|no\s+experience\s+with|without\s+using|migrated\s+away\s+from|instead\s+of|neither|not\s+proficient\s+in)\b",
    r"\b(do\s+not\s+know|have\s+not\s+used|haven't\s+used|didn't\s+use)\b",
)
LEARNING = (r"\b(currently\s+learning|in\s+the\s+process\s+of\s+learning|learning\s+basics\s+of|beginner\s+in|studying)\b",)
# Words that no skill's name has.
NOT_A_SKILL = r"\b(developed|built|implemented|worked|created|designed|managed|led|used|using|with|and)\b"


def sentence_class(c: Column) -> Column:
    """aspiration, negated, learning or plain: the first that fits."""
    low = F.lower(F.coalesce(c, F.lit("")))
    any_of = lambda patterns: low.rlike("|".join(patterns))
    return F.when(any_of(ASPIRATION), "aspiration").when(any_of(NEGATED), "negated").when(any_of(LEARNING), "learning").otherwise("plain")


# Names of sections that stand before skills.
SECTION_NAMES = (
    r"(?:languages?|programming\s+languages?|frontend|backend|databases?|cloud|tools?|platforms?|frameworks?|libraries|apis?|web\s+technologies?|skills?|technologies?|"
    r"tools\s+&?\s*platforms?|cloud\s*/?\s*deployment|devops|testing|ui\s*/?\s*ux|soft\s+skills?|certifications?|other|additional|misc(?:ellaneous)?)"
)
LABEL_INSIDE, LABEL_BEFORE = rf"{SECTION_NAMES}\s*:", rf"^{SECTION_NAMES}\s*:?\s*"


def atomic_skill(c: Column) -> Column:
    """Whether a text names one skill: at most 80 characters, 7 words and one comma, no label, no section's name with nothing or a list after it, no verb of a sentence."""
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    commas = F.length(c) - F.length(F.translate(c, ",", ""))
    rest = F.trim(F.regexp_replace(c, f"(?i){LABEL_BEFORE}", ""))
    bare = c.rlike(f"(?i){LABEL_BEFORE}") & ((rest == "") | rest.contains(","))
    return (F.length(c) > 0) & (F.length(c) <= 80) & (words <= 7) & (commas < 2) & ~c.rlike(r"\w+\s*:\s*\w") & ~bare & ~F.lower(c).rlike(NOT_A_SKILL)


def atoms(c: Column) -> Column:
    """The skills that a text lists: cut where a section's name and a colon stand, at commas and at slashes; only parts that name one skill."""

    def tokens(part: Column) -> Column:
        shorn = F.trim(F.regexp_replace(F.trim(part), f"(?i){LABEL_BEFORE}", ""))
        items = F.filter(F.transform(F.split(shorn, ","), lambda x: F.trim(x)), lambda x: x != "")
        halves = lambda x: F.filter(F.transform(F.split(x, "/"), lambda y: F.trim(y)), lambda y: y != "")
        return F.flatten(F.transform(items, lambda x: F.when(F.size(halves(x)) > 1, halves(x)).otherwise(F.array(x))))

    parts = F.split(F.coalesce(c, F.lit("")), f"(?i){LABEL_INSIDE}")
    return F.filter(F.flatten(F.transform(parts, tokens)), atomic_skill)


# Words by which a first line is an instruction, and marks that are stripped from its end.
INSTRUCTS = ("summarize", "category", "critique", "rewrite", "skills", "extract", "resume")


def instruction_body(c: Column, patterns: Sequence[str], default: str) -> Column:
    """(instruction, body): an anchored pattern, else a first line under 120 characters that ends with ``?`` or ``:`` or
    has a word of ``INSTRUCTS``, else the default and all.  Colons, dashes and spaces go from the instruction's end."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    text = strip(F.coalesce(c, F.lit("")))
    head = F.substring_index(text, "\n", 1)
    first = strip(head)
    asks = first.rlike("[?:]$") | F.lower(first).rlike("|".join(INSTRUCTS))
    by_line = F.contains(text, F.lit("\n")) & (F.length(first) < 120) & asks
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?is)^({p})", 1), F.lit("")) for p in patterns], F.lit(""))

    def pair(instruction: Column, used: Column) -> Column:
        return F.struct(F.regexp_replace(strip(instruction), r"[:\-\s]+$", "").alias("instruction"), strip(F.substring(text, F.length(used) + 1, F.length(text))).alias("body"))

    return F.when(found != "", pair(found, found)).when(by_line, pair(first, head)).otherwise(F.struct(F.lit(default).alias("instruction"), text.alias("body")))


def proficiency(c: Column) -> Column:
    """(skill, level) of ``Skill (Level)`` and ``Skill: Level``, in order."""
    levels = "Basic|Beginner|Intermediate|Advanced|Expert"
    whole = F.regexp_extract_all(c, F.lit(rf"([A-Za-z0-9+#. ]+?) ?(\(|: ?)({levels})\b"), 0)
    cut = lambda x, g: F.trim(F.regexp_extract(x, rf"^(.+?) ?(\(|: ?)({levels})$", g))
    return F.transform(whole, lambda x: F.struct(cut(x, 1).alias("skill"), cut(x, 3).alias("level")))


def additive_score(points: Mapping[str, tuple[Column, float]], cap: float) -> Column:
    """Sum of the points whose condition holds, up to cap."""
    return F.least(F.lit(cap), sum((F.when(hit, F.lit(p)).otherwise(0.0) for hit, p in points.values()), F.lit(0.0)))


def merge_lists(left: Column, right: Column) -> Column:
    """Both lists in order, each value once, letter case aside; the first spelling wins."""
    both = F.concat(F.coalesce(left, F.array()), F.coalesce(right, F.array()))
    low = F.transform(both, F.lower)
    return F.filter(both, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def capped_gaps(core: Column, important: Column, most_core: int = 4, most: int = 5) -> Column:
    """At most ``most_core`` core gaps, filled up to ``most`` with important ones."""
    return F.slice(F.concat(F.slice(core, 1, most_core), important), 1, most)


def canonical_name(rows: DataFrame, raw: str, names: DataFrame) -> DataFrame:
    """Adds ``canonical`` by names (alias, canonical): the exact text, then without brackets, else the text itself."""
    clean = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    base = F.trim(F.regexp_replace(clean, r"\s*\([^)]*\)", ""))
    known = names.select(F.lower("alias").alias("alias"), F.col("canonical").alias("name")).groupBy("alias").agg(F.min("name").alias("name"))
    keyed = rows.withColumns({"raw_key": F.lower(clean), "base_key": F.lower(base)})
    one = known.select(F.col("alias").alias("raw_key"), F.col("name").alias("by_raw"))
    two = known.select(F.col("alias").alias("base_key"), F.col("name").alias("by_base"))
    joined = keyed.join(one, "raw_key", "left").join(two, "base_key", "left")
    return joined.withColumn("canonical", F.coalesce("by_raw", "by_base", clean)).drop("raw_key", "base_key", "by_raw", "by_base")
