"""Date formats of the dialect as Java patterns, and date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: MySQL date specifiers and the Java patterns with the same output.
SPECIFIERS = {
    "a": "EEE", "b": "MMM", "c": "M", "d": "dd", "e": "d", "f": "SSSSSS", "H": "HH", "h": "hh", "I": "hh", "i": "mm", "j": "DDD",
    "k": "H", "l": "h", "M": "MMMM", "m": "MM", "p": "a", "r": "hh:mm:ss a", "S": "ss", "s": "ss", "T": "HH:mm:ss", "W": "EEEE", "Y": "yyyy", "y": "yy",
}


#: Specifiers (week numbers, day of the week as a number, ordinals) that no Java pattern has.
WITHOUT_PATTERN = set("DUuVvwXx")


def java_pattern(mysql: str) -> str:
    """The Java pattern for a MySQL format; letters that are no specifier are quoted."""
    out, quoted, i = "", "", 0

    def flush() -> str:
        return "'" + quoted.replace("'", "''") + "'" if any(x.isalpha() for x in quoted) else quoted.replace("'", "''")

    while i < len(mysql):
        if mysql[i] == "%" and i + 1 < len(mysql):
            name = mysql[i + 1]
            i += 2
            if name in SPECIFIERS:
                out, quoted = out + flush() + SPECIFIERS[name], ""
            elif name in WITHOUT_PATTERN:
                raise ValueError(f"%{name} is not supported in date formats")
            else:
                quoted += name
        else:
            quoted += mysql[i]
            i += 1
    return out + flush()


def str_to_date(text: Column | str, fmt: str) -> Column:
    """Timestamp without zone; null where the text does not match."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text, F.lit(java_pattern(fmt))).cast("timestamp_ntz")


def date_format(value: Column | str, fmt: str) -> Column:
    return F.date_format(value, java_pattern(fmt))


def date_diff_days(a: Column | str, b: Column | str) -> Column:
    """Days from b to a."""
    return F.datediff(a, b)


def add_interval(value: Column, amount: int, unit: str) -> Column:
    return value + F.expr(f"INTERVAL {int(amount)} {unit}")


def add_seconds(value: Column, seconds: Column) -> Column:
    """A date-time plus a number: the number counts seconds."""
    return value + F.make_dt_interval(secs=seconds)


def time_diff(a: Column, b: Column) -> Column:
    """a - b as text [-]HH:mm:ss."""
    seconds = F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp"))
    size = F.abs(seconds)
    hours = F.floor(size / 3600)
    shown = F.format_string("%02d:%02d:%02d", hours, F.floor(size % 3600 / 60), size % 60)
    return F.concat(F.when(seconds < 0, "-").otherwise(""), shown)
