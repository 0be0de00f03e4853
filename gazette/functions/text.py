"""Text and date expressions."""

from pyspark.sql import Column, functions as F

from gazette.functions.arrays import col


def joined_text(*columns) -> Column:
    """Values joined by a space; a null makes the result null."""
    parts = [col(columns[0])]
    for c in columns[1:]:
        parts += [F.lit(" "), col(c)]
    return F.concat(*parts)


def list_text(c) -> Column:
    """List elements joined by a space; nulls are skipped."""
    return F.array_join(col(c), " ")


def word_count(c) -> Column:
    """Pieces between single spaces; 0 for empty or null text."""
    c = col(c)
    return F.when(c != "", F.size(F.split(c, " "))).otherwise(F.lit(0))


_GAP = r"[^\p{L}\p{N}]+"


def spaced_words(c) -> Column:
    """``words`` joined by a space: one string to hand to a task instead of a list of many."""
    return F.trim(F.regexp_replace(F.lower(col(c)), _GAP, " "))


def words(c) -> Column:
    """Lower-cased runs of letters and digits in order."""
    return F.filter(F.split(F.lower(col(c)), _GAP), lambda w: w != "")


def format_delta(seconds) -> Column:
    """A number of whole seconds as ``"D days H:M:S"`` without zero padding."""
    s = col(seconds).cast("bigint")
    day, hour = F.lit(86400), F.lit(3600)
    return F.concat(
        F.floor(s / day).cast("string"),
        F.lit(" days "),
        F.floor(F.pmod(s, day) / hour).cast("string"),
        F.lit(":"),
        F.floor(F.pmod(s, hour) / 60).cast("string"),
        F.lit(":"),
        F.pmod(s, F.lit(60)).cast("string"),
    )


def seconds_between(later, earlier) -> Column:
    """Seconds between two timestamps of the same type; no time zone is involved."""
    gap = col(later) - col(earlier)
    part = lambda unit: F.extract(F.lit(unit), gap)
    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND").cast("double")


def timestamp_text(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")
