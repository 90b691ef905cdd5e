"""Cron rules over minutes, and the claims that make each firing happen once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of months and weekdays; Sunday is 1 in numbers.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
WEEKDAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")
FIELDS = (("minute", 0, 59, ()), ("hour", 0, 23, ()), ("day", 1, 31, ()), ("month", 1, 12, MONTHS), ("weekday", 1, 7, WEEKDAYS))


def parse_field(text: str, least: int, most: int, names: tuple[str, ...] = ()) -> list[int]:
    """The values of lists, ranges and steps; a single value with a step is only itself."""

    def number(x: str) -> int:
        value = names.index(x.upper()) + 1 if x.upper() in names else int(x)
        if not least <= value <= most:
            raise ValueError(f"{x} is not in {least}..{most}")
        return value

    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            low, high = least, most
        else:
            a, _, b = span.partition("-")
            low, high = number(a), number(b or a)
        if low > high or step and int(step) < 1:
            raise ValueError(f"bad part {part!r}")
        out.update(range(low, high + 1, int(step or 1)))
    return sorted(out)


def parse_cron(text: str) -> dict[str, list[int] | bool]:
    """The values of the five fields, and whether day and weekday are exactly ``*``."""
    parts = text.split()
    if len(parts) != 5:
        raise ValueError("a cron rule has five fields")
    out: dict[str, list[int] | bool] = {name: parse_field(p, low, high, names) for p, (name, low, high, names) in zip(parts, FIELDS, strict=True)}
    return out | {"any_day": parts[2] == "*", "any_weekday": parts[4] == "*"}


def matches(rule: dict, minute: Column) -> Column:
    """Whether a timestamp (UTC) fires: day and weekday are joined by OR once both are restricted."""
    day, weekday = F.dayofmonth(minute).isin(rule["day"]), F.dayofweek(minute).isin(rule["weekday"])
    days = F.lit(True) if rule["any_day"] and rule["any_weekday"] else weekday if rule["any_day"] else day if rule["any_weekday"] else day | weekday
    return F.minute(minute).isin(rule["minute"]) & F.hour(minute).isin(rule["hour"]) & F.month(minute).isin(rule["month"]) & days


def firings(schedules: DataFrame, rules: list[str], now: str, catch_up_days: int = 7) -> DataFrame:
    """workflow, cron, scheduled_time (ms): the minutes after each cursor up to ``now`` that fire; at most ``catch_up_days`` back."""
    end = F.date_trunc("minute", F.lit(now).cast("timestamp"))
    begin = F.greatest(F.date_trunc("minute", F.col("cursor")) + F.expr("interval 1 minute"), end - F.expr(f"interval {catch_up_days} days") + F.expr("interval 1 minute"))
    minutes = schedules.where(begin <= end).withColumn("minute", F.explode(F.sequence(begin, end, F.expr("interval 1 minute"))))
    fires = F.lit(False)
    for text in rules:
        fires = fires | ((F.col("cron") == text) & matches(parse_cron(text), F.col("minute")))
    return minutes.where(fires).select("workflow", "cron", F.unix_millis("minute").alias("scheduled_time"))


def claims(fired: DataFrame, taken: DataFrame) -> DataFrame:
    """``fired`` once each with its instance id, without those already ``taken``."""
    key = ["workflow", "cron", "scheduled_time"]
    rows = fired.dropDuplicates(key).join(taken.select(*key), key, "left_anti")
    digest = F.sha2(F.concat_ws("\0", "workflow", "cron", F.col("scheduled_time").cast("string")), 256)
    return rows.withColumn("instance_id", F.concat(F.lit("cf_"), digest))
