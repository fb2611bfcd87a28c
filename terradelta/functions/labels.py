"""Text and label expressions.  All take and return columns and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terradelta.functions.numbers import number_text, rounded_to

MISSING = "Not available"
# fixed values: the words shown for each state
BEHAVIOUR_LABELS = {
    "repeated_change": "Widespread repeated change",
    "mixed_change": "Some repeated change",
    "mostly_single_period_change": "Change mainly once",
    "low_change_reference": "Mostly unchanged",
}
BEHAVIOUR_COLOURS = {
    "repeated_change": "#b73143",
    "mixed_change": "#dc7927",
    "mostly_single_period_change": "#e7ad3b",
    "low_change_reference": "#2c70a5",
}
DIRECTION_LABELS = {
    "greening": "Greener than at study start",
    "browning": "Less green than at study start",
    "stable": "Similar greenness to study start",
}
TREND_LABELS = {"increasing": "Increasing", "decreasing": "Decreasing", "no_clear_trend": "No clear trend"}
PATTERN_LABELS = {"fairly_consistent": "Similar each year", "mixed": "Some years stand out", "highly_uneven": "A few years dominate"}
GREY = "#7b858a"
NO_CLASS = "Unknown 0"


def choose(key: Column, table: dict[str, str], default: str) -> Column:
    """Look a small fixed table up by a chain of conditions."""
    out = None
    for k, v in table.items():
        out = (F if out is None else out).when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def behaviour_label(c: Column) -> Column:
    return choose(c, BEHAVIOUR_LABELS, BEHAVIOUR_LABELS["mixed_change"])


def behaviour_colour(c: Column) -> Column:
    return choose(c, BEHAVIOUR_COLOURS, GREY)


def direction_label(c: Column) -> Column:
    return choose(c, DIRECTION_LABELS, MISSING)


def trend_label(c: Column) -> Column:
    return choose(c, TREND_LABELS, MISSING)


def pattern_label(c: Column) -> Column:
    return choose(c, PATTERN_LABELS, MISSING)


def plain_label(c: Column) -> Column:
    """Underscores to spaces; the first letter of every word upper case, the rest as it is."""
    parts = F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" ")), r"\b")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), "")


def escape_markup(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_of(*parts: Column) -> Column:
    """The first that is neither missing nor empty."""
    return F.coalesce(*[blank_to_null(p) for p in parts])


def joined(*parts: Column) -> Column:
    """Non-empty parts with a middle dot between."""
    return F.concat_ws(" · ", *[blank_to_null(p) for p in parts])


def trimmed_lower(c: Column) -> Column:
    """Trim all white space, not only blanks, and lower the case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s   -     　﻿]+|[\s   -     　﻿]+$", ""))


def record_title(feature_type: Column) -> Column:
    return F.when(feature_type.eqNullSafe(F.lit("coldspot_patch")), F.lit("Low-change area")).otherwise(F.lit("Landscape change area"))


def detailed_class(c: Column) -> Column:
    return F.coalesce(F.nullif(blank_to_null(c), F.lit(NO_CLASS)), F.lit("Detailed class unavailable"))


def interval_label(iv: Column) -> Column:
    """2017_2018 as "2017 → 2018"; the overview by its own name."""
    return F.when(iv == "endpoint", F.lit("2017–2024 overview")).otherwise(F.concat_ws(" → ", F.split(iv, "_")))


def interval_short(iv: Column) -> Column:
    years = F.split(iv, "_")
    return F.when(iv == "endpoint", F.lit("overview")).otherwise(F.concat(F.substring(F.get(years, F.lit(0)), 3, 2), F.lit("–"), F.substring(F.get(years, F.lit(1)), 3, 2)))


# fixed values: sentences on repeated change; most follow the share in whole percent
SUMMARY_LOW = "Little or no strong embedding change was detected here across the study period."
SUMMARY_REPEATED = "% of this area changed strongly in at least two annual periods. Repeated change was therefore widespread across the area."
SUMMARY_MIXED = "% of this area changed strongly in at least two annual periods. Some parts changed repeatedly, while others changed once or not strongly."
SUMMARY_NEVER_TWICE = "Strong change was detected, but no part of this area crossed the annual strong-change threshold in more than one period."
SUMMARY_SINGLE = ("Strong change was mostly isolated to one annual period at each location. ", "% of the area changed strongly more than once.")


def repeat_sentence(behaviour: Column, coverage: Column) -> Column:
    """What share of an area changed strongly in two or more periods, in words."""
    percent = F.floor(F.coalesce(coverage, F.lit(0.0)) * 100 + 0.5).cast("string")
    return (
        F.when(behaviour == "low_change_reference", F.lit(SUMMARY_LOW))
        .when(behaviour == "repeated_change", F.concat(percent, F.lit(SUMMARY_REPEATED)))
        .when(behaviour == "mixed_change", F.concat(percent, F.lit(SUMMARY_MIXED)))
        .when(percent == "0", F.lit(SUMMARY_NEVER_TWICE))
        .otherwise(F.concat(F.lit(SUMMARY_SINGLE[0]), percent, F.lit(SUMMARY_SINGLE[1])))
    )


# the sentences below are fixed values, too
def land_headline(outcome: Column, first: Column, last: Column) -> Column:
    return F.when(outcome == "stayed", F.concat(F.lit("Stayed "), first)).when(outcome == "returned", F.concat(F.lit("Returned to "), last)).otherwise(F.concat(first, F.lit(" → "), last))


def land_note(outcome: Column, first_change: Column, last_year: int = 2024) -> Column:
    """When a region's class changed first; the year is missing for 0 and less."""
    year = F.when(first_change > 0, first_change.cast("string"))
    return (
        F.when(outcome == "stayed", F.lit("The dominant mapped broad class was unchanged in every annual DEA map."))
        .when(outcome == "returned", F.concat(F.lit("The dominant mapped broad class first changed in "), F.coalesce(year, F.lit("an intermediate year")), F.lit(f", then returned by {last_year}.")))
        .otherwise(F.concat(F.lit("The first change in the dominant mapped broad class was detected in "), F.coalesce(year, F.lit("the annual sequence")), F.lit(".")))
    )


def ndvi_note(change: Column) -> Column:
    amount = F.when(change == 0, F.lit("")).otherwise(F.concat(F.lit(" by "), number_text(rounded_to(F.abs(change), 3), 3)))
    return F.concat(F.lit("Average NDVI "), ndvi_action(change), amount, F.lit(" between the first and last study years."))


def place_title(feature_type: Column, locality: Column) -> Column:
    near = F.when(feature_type.eqNullSafe(F.lit("coldspot_patch")), F.lit("Low-change area near ")).otherwise(F.lit("Landscape change near "))
    return F.concat(near, locality)


def ndvi_action(change: Column) -> Column:
    return F.when(change > 0, "increased").when(change < 0, "decreased").when(change.isNotNull(), "was unchanged")


def shard_of(feature_id: Column, size: int = 1000) -> Column:
    """Number of the shard that holds an id: its digits, less one, by shard size."""
    number = F.regexp_replace(feature_id, "[^0-9]", "").try_cast("bigint")
    return F.floor((number - 1) / F.lit(size)).cast("bigint")


def zero_padded(c: Column, width: int = 3) -> Column:
    text = c.cast("string")
    return F.when(F.length(text) > width, text).otherwise(F.lpad(text, width, "0"))
