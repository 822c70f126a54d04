"""Text of the searched fields, dates that rank and filter, links, and what an embedder is given: all column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that never feed the properties field, and the widths an embedder runs at. Results depend on them.
NO_VALUES = (
    "icon coordinates cssclasses cssclass protected version completed completeddate position banner banner_y tags aliases alias created modified datelink"
).split()
INDEX_WIDTHS = [32, 48, 64, 96, 128, 192, 256, 384, 512]
QUERY_WIDTHS = [8, 16, 32, 48, 64, 96, 128]
BUDGET, WIDEST_TOKEN, CHARS_A_TOKEN, PAD_RUN = 512, 64, 4.5, 16
ROLLING, MOST_AT_ONCE = 512, 8
TITLE_OPENS = 0.5
# End of fixed values.

DAY = r"\d{4}-\d{2}-\d{2}"


def note_name(title: Column) -> Column:
    """The title without its heading path and alias tail."""
    return F.trim(F.substring_index(F.substring_index(title, " > ", 1), " | ", 1))


def aliases_text(aliases: Column, title: Column) -> Column:
    """Aliases in a row; without any, the alias tail of the title."""
    tail = F.array_join(F.slice(F.split(F.substring_index(title, " > ", 1), r" \| "), 2, 10_000), " ")
    return F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, F.array_join(aliases, " ")).otherwise(tail)


def joined(values: Column) -> Column:
    return F.coalesce(F.array_join(values, " "), F.lit(""))


def shown_value(v: Column) -> Column:
    """A property value as displayed: one pair of quotes off, links as the last segment of their target."""
    bare = F.regexp_replace(v, "^[\"']|[\"']$", "")
    return F.trim(F.regexp_replace(bare, r"\[\[(?:[^\]|#^]*/)?([^\]|#^/]*)[^\]]*\]\]", "$1"))


def properties_text(properties: Column) -> Column:
    """Displayed values of all properties but machinery and those with fields of their own; pure dates and numbers stay out."""
    held = F.map_filter(properties, lambda k, _: ~F.lower(k).isin(NO_VALUES))
    values = F.transform(F.flatten(F.map_values(held)), shown_value)
    date = rf"(?i)^{DAY}(?:[ T]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)?)?$"
    return F.coalesce(F.array_join(F.filter(values, lambda v: (v != "") & ~v.rlike(date) & ~v.rlike(r"^-?[\d., ]+$")), " "), F.lit(""))


def searched(chunks: DataFrame) -> DataFrame:
    """chunk_id and the text of each field of an index: names, aliases, tags, content with what cleaning dropped, properties, headings."""
    return chunks.select(
        "chunk_id",
        note_name(F.col("title")).alias("title"),
        aliases_text(F.col("aliases"), F.col("title")).alias("aliases"),
        joined(F.col("tags")).alias("tags"),
        F.concat_ws(" ", "content", "link_terms").alias("content"),
        properties_text(F.col("properties")).alias("properties"),
        joined(F.col("heading_path")).alias("headings"),
    )


# Dates


def filename_day(path: Column) -> Column:
    """The first day in a file's name, if its month and day exist on some calendar."""
    found = F.regexp_extract(F.substring_index(path, "/", -1), f"({DAY})", 1)
    fine = F.substring(found, 6, 2).cast("int").between(1, 12) & F.substring(found, 9, 2).cast("int").between(1, 31)
    return F.when((found != "") & fine, found)


def property_day(properties: Column, created: Column, key: str) -> Column:
    """The chosen property's first value; `created` has a column of its own."""
    return created if key == "created" else F.get(F.try_element_at(properties, F.lit(key)), F.lit(0))


def recency_date(created: Column, modified: Column, properties: Column, path: Column, key: str = "created", created_key: str = "created") -> Column:
    """The date that ranks: property, then created, then the file's name, then the time of change; by `modified` the time of change comes first."""
    own = F.coalesce(property_day(properties, created, created_key), created, filename_day(path))
    return F.coalesce(modified, own) if key == "modified" else F.coalesce(own, modified)


def filter_date(created: Column, modified: Column, properties: Column, key: str = "created", created_key: str = "created") -> Column:
    """The date that filters: the chosen property or the time of change, never the file's name."""
    return modified if key == "modified" else F.coalesce(property_day(properties, created, created_key), modified)


def shown_day(text: Column) -> Column:
    """YYYY-MM-DD of a date or time stamp, or an empty text; UTC. Days past a month's end roll on."""
    part = lambda k, n: F.try_element_at(F.split(F.substring(text, 1, 10), "-"), F.lit(k)).try_cast("int") if n else None
    bare = F.when(text.rlike(f"^{DAY}"), F.date_add(F.add_months(F.make_date(part(1, 1), F.lit(1), F.lit(1)), part(2, 1) - 1), part(3, 1) - 1))
    return F.coalesce(F.date_format(F.coalesce(bare, text.try_cast("timestamp").cast("date")), "yyyy-MM-dd"), F.lit(""))


def presets(today: dt.date) -> list[tuple[str, str]]:
    """(value, label) of the dates offered for after: and before:."""
    return [(f"{today:%Y-%m}", "this month"), (f"{today.year}", "this year"), (f"{today.year - 1}", "last year"), (f"{today.year - 2}", f"{today.year - 2}")]


# Links


def title_coverage_shown(boost: Column, weight: float) -> Column:
    """The coverage behind a weighted title boost; with the boost off there is none to read."""
    return boost / F.lit(weight) if weight > 0 else F.lit(0.0)


def note_link(path: Column, heading_path: Column, coverage: Column, alias: Column) -> Column:
    """[[Note#Heading|alias]]: no heading where the title answers the query, or where the only heading is the note's name."""
    base = F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.md$", "")
    last = F.trim(F.coalesce(F.try_element_at(heading_path, F.lit(-1)), F.lit("")))
    same = (F.size(heading_path) == 1) & (F.lower(last) == F.lower(F.trim(base)))
    sub = F.when((coverage >= TITLE_OPENS) | F.coalesce(same, F.lit(False)) | (last == ""), "").otherwise(F.concat(F.lit("#"), last))
    name = F.trim(F.coalesce(alias, F.lit("")))
    return F.concat(F.lit("[["), base, sub, F.when(name != "", F.concat(F.lit("|"), name)).otherwise(""), F.lit("]]"))


# What an embedder is given


def collapse_padding(text: Column) -> Column:
    return F.regexp_replace(text, rf"[ \t]{{{PAD_RUN},}}", " ")


def embed_input(title: Column, content: Column, suffix: Column) -> Column:
    """Title, content and suffix apart by empty lines, long runs of blanks collapsed, cut where no token of the budget can stand."""
    tail = F.when(F.coalesce(suffix, F.lit("")) != "", F.concat(F.lit("\n\n"), suffix)).otherwise("")
    return F.substring(collapse_padding(F.concat(title, F.lit("\n\n"), content, tail)), 1, BUDGET * WIDEST_TOKEN)


def gated_count(text: Column, counted: Column, budget: int = BUDGET) -> Column:
    """The token count, but for texts too long to fit in any case, which are over the budget by their length alone."""
    n = F.length(collapse_padding(text))
    return F.when(n > budget * WIDEST_TOKEN, F.greatest(F.lit(budget + 1).cast("long"), F.ceil(n / CHARS_A_TOKEN))).otherwise(counted.cast("long"))


def width(tokens: Column, widths: list[int] = INDEX_WIDTHS) -> Column:
    """The least width that holds so many tokens, or the greatest there is."""
    return F.coalesce(F.array_min(F.filter(F.array(*[F.lit(w) for w in widths]), lambda w: w >= tokens)), F.lit(widths[-1]))


def batch_size(of_width: Column) -> Column:
    """How many texts of a width go in one call."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_AT_ONCE), F.floor(ROLLING / of_width + 0.5).cast("int")))
