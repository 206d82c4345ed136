"""Column expressions for titles and article text (JVM side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must agree with the data's existing normalisation.
NUMBER_PATTERN = r"((?<=\s)|^).?\d+.?((?=\s)|$)"
URL_PATTERN = (
    r"(https?:\/\/)?(www\.)?[-a-zA-Z0-9@:%._\+~#=]{2,256}\.[a-z]{2,6}\b([-a-zA-Z0-9@:%_\+.~#?&//=]*)"
)
BRACKET_TAG_PATTERN = r"\[[A-Za-z=\- 0-9]+\]"
METADATA_WORDS = [
    "BYLINE",
    "SECTION",
    "LENGTH",
    "RELATED",
    "LANGUAGE",
    "HIGHLIGHT",
    "GRAPHIC",
    "PUBLICATION-TYPE",
]

# Java needs (?U) for Unicode classes; (?d) makes '.' stop at \n only.
_UNICODE = "(?dU)"
# Letters, numbers and underscore: the Unicode word characters.
WORD_CLASS = r"[\p{L}\p{N}_]"
_BLANK = r"[\s\x1c-\x1f]"


def strip_blanks(col: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.regexp_replace(col, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def collapse_blanks(col: Column) -> Column:
    """Each run of white space becomes one space; ends are trimmed."""
    return strip_blanks(F.regexp_replace(col, f"(?U){_BLANK}+", " "))


def filter_text(col: Column) -> Column:
    """Drop quotes, commas and dots, lower-case, drop number tokens, trim."""
    # translate maps the tab to a blank and deletes the three characters after it
    plain = F.lower(F.translate(col, '\t",.', " "))
    return strip_blanks(F.regexp_replace(plain, _UNICODE + NUMBER_PATTERN, ""))


def word_count(col: Column) -> Column:
    """Number of maximal runs of word characters."""
    return F.regexp_count(col, F.lit(WORD_CLASS + "+"))


def trend_title(col: Column) -> Column:
    """Title form used when titles meet labels: no commas, lower case."""
    return F.lower(F.regexp_replace(col, ",", ""))


def body_lines(col: Column) -> Column:
    """Lines of a body without the first one (the title), each trimmed."""
    lines = F.split(col, "\n")
    return F.transform(
        F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), strip_blanks
    )


def is_metadata_line(col: Column) -> Column:
    return col.rlike("^(" + "|".join(METADATA_WORDS) + "):")


def blank_urls(col: Column) -> Column:
    return F.regexp_replace(col, "(?U)" + URL_PATTERN, " ")


def blank_bracket_tags(col: Column) -> Column:
    return F.regexp_replace(col, BRACKET_TAG_PATTERN, " ")


def drop_date_lines(lines: Column) -> Column:
    from presssignal.functions.dates import is_date_line

    return F.filter(lines, lambda x: ~is_date_line(x))


def drop_metadata_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~is_metadata_line(x))


def tidy_lines(lines: Column) -> Column:
    """Tabs to blanks, trim, drop lines that are empty."""
    return F.filter(
        F.transform(lines, lambda x: strip_blanks(F.translate(x, "\t", " "))),
        lambda x: x != "",
    )


def clean_body(col: Column) -> Column:
    """Body text to one normalised string: the whole line chain, then ``filter_text``."""
    from presssignal.functions.dates import blank_dates

    lines = drop_metadata_lines(drop_date_lines(body_lines(col)))
    lines = F.transform(lines, lambda x: blank_bracket_tags(blank_urls(blank_dates(x))))
    return filter_text(F.array_join(tidy_lines(lines), " "))


def to_class(label: Column) -> Column:
    """0 becomes -1, anything else 1."""
    return F.when(label == 0, F.lit(-1)).otherwise(F.lit(1))


def up_down(change: Column) -> Column:
    """1 when the change is not negative, else 0."""
    return F.when(change >= 0, F.lit(1)).otherwise(F.lit(0))
