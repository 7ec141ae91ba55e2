"""Nested JSON of any shape as VARIANT: fences cut, bad texts null, aliases tried in order, unions brought to arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(c: Column) -> Column:
    """The text between code fences where the text begins with one, without the word json; else the text; trimmed."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    inside = F.get(F.split(text, "```"), F.lit(1))
    bare = F.when(text.startswith("```"), F.regexp_replace(inside, r"^json", "")).otherwise(text)
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def parsed(c: Column) -> Column:
    """A VARIANT, null where the text is no JSON."""
    return F.try_parse_json(F.nullif(unfenced(c), F.lit("")))


def kind(v: Column) -> Column:
    """array, object, text or other; null for nothing and for JSON's null."""
    of = F.schema_of_variant(v)
    named = F.when(of.startswith("ARRAY"), "array").when(of.startswith("OBJECT"), "object").when(of == "STRING", "text").otherwise("other")
    return F.when(v.isNotNull() & ~F.is_variant_null(v), named)


def text(v: Column, *paths: str) -> Column:
    """The first of the paths that holds a text or number that is not blank."""
    found = [F.nullif(F.trim(F.try_variant_get(v, p, "string")), F.lit("")) for p in paths]
    return F.coalesce(*[F.when(~kind(F.try_variant_get(v, p, "variant")).isin("array", "object"), x) for p, x in zip(paths, found)])


def items(v: Column, *paths: str) -> Column:
    """The first of the paths that holds an array or an object, as an array of VARIANT: an object is one item; else empty."""
    none = F.array().cast("array<variant>")
    each = []
    for p in paths:
        at = F.try_variant_get(v, p, "variant")
        each.append(F.when(kind(at) == "array", F.try_variant_get(v, p, "array<variant>")).when(kind(at) == "object", F.array(at)))
    return F.coalesce(*each, none)


def texts(v: Column, *paths: str) -> Column:
    """The first of the paths that holds anything, as texts: an array's items, a text cut at commas, the flattened values of an object in the order of its keys."""
    none = F.array().cast("array<string>")
    clean = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")

    def of(at: Column) -> Column:
        listed = F.transform(F.try_variant_get(at, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
        entries = F.array_sort(F.map_entries(F.try_variant_get(at, "$", "map<string,string>")))
        nested = F.flatten(F.transform(entries, lambda e: F.coalesce(F.from_json(e["value"], "array<string>", {"mode": "PERMISSIVE"}), F.array(F.coalesce(e["value"], F.lit(""))))))
        return F.when(kind(at) == "array", clean(listed)).when(kind(at) == "text", clean(F.split(F.try_variant_get(at, "$", "string"), ","))).when(kind(at) == "object", clean(nested))

    return F.coalesce(*[of(F.try_variant_get(v, p, "variant")) for p in paths], none)
