"""Pure decisions as Column expressions: identity, retry delays, deadlines, durations, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The defaults of a step.
RETRY_LIMIT, RETRY_DELAY_MS, RETRY_BACKOFF, WAIT_MS = 5, 10_000, "exponential", 86_400_000
EXECUTABLE = ("queued", "running", "waiting", "waitingForPause")
TERMINAL = ("complete", "errored", "terminated")
#: Delays are 64-bit and stop here; an exponent over 40 would pass it in any case.
DELAY_CAP_MS = 1 << 52
#: Milliseconds of a duration's unit; a month has 30 days and a year 365.
UNIT_MS = {
    "millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000,
    "week": 604_800_000, "month": 2_592_000_000, "year": 31_536_000_000,
}

#: Milliseconds of a unit in the retention of a batch request.
BATCH_UNIT_MS = {"minute": 60_000, "second": 1000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_592_000_000, "year": 31_557_600_000}
#: Words that are no instance ids in a batch request, and the most requests in one.
RESERVED_IDS, BATCH_MOST = ("batch", "terminate", "terminateAll"), 100
#: Days that a plan keeps instances for.
PLAN_DAYS = {"free": 3, "paid": 7}


def step_key(instance: Column, kind: Column, name: Column, count: Column) -> Column:
    return F.concat_ws("/", instance.cast("string"), kind, name, count.cast("string"))


def retry_delay_ms(base: Column, attempt: Column, backoff: Column) -> Column:
    """Before the attempt after ``attempt``: a negative base is 0, an unknown backoff constant."""
    base = F.greatest(base.cast("long"), F.lit(0).cast("long"))
    power = F.expr("1L").cast("double") * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(52)))
    grown = F.when(backoff == "linear", base.cast("double") * attempt).when(backoff == "exponential", base.cast("double") * power).otherwise(base.cast("double"))
    return F.least(grown, F.lit(float(DELAY_CAP_MS))).cast("long")


def is_terminal_failure(attempt: Column, limit: Column, non_retryable: Column) -> Column:
    """A limit of n allows n + 1 attempts."""
    return non_retryable | (attempt > limit)


def deadline_ready(now: Column, wake_at: Column) -> Column:
    return now >= wake_at


def can_execute(status: Column) -> Column:
    return status.isin(*EXECUTABLE)


def duration_ms(text: Column) -> Column:
    """``<n> unit``, the unit whole, in either case, with or without an ``s``; or plain milliseconds. Anything else is null."""
    pattern = rf"(?i)\A\s*(\d+(?:\.\d+)?)(?:\s*({'|'.join(UNIT_MS)})s?)?\s*\z"
    number, unit = F.regexp_extract(text, pattern, 1), F.lower(F.regexp_extract(text, pattern, 2))
    scale = F.coalesce(*[F.when(unit == name, F.lit(ms)) for name, ms in UNIT_MS.items()], F.lit(1))
    return F.when(number != "", F.floor(number.cast("double") * scale)).cast("long")


def batch_retention_ms(text: Column) -> Column:
    """The retention of a batch request: a number of milliseconds, or ``<n> unit``, where an unknown unit is a millisecond.

    Null for what is no number or not above 0. Unlike in ``duration_ms`` a year has 365.25 days, and only small letters name a unit.
    """
    pattern = r"\A([^ ]+) +(\w\w*?)s?\z"
    number = lambda c: F.when(c.rlike(r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"), F.trim(c).try_cast("double"))
    unit = F.regexp_extract(text, pattern, 2)
    scale = F.coalesce(*[F.when(unit == name, F.lit(float(ms))) for name, ms in BATCH_UNIT_MS.items()], F.lit(1.0))
    ms = F.coalesce(number(text), number(F.regexp_extract(text, pattern, 1)) * scale)
    return F.when((ms > 0) & (ms < float("inf")), ms)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp with or without a zone (UTC)."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """One decimal, halves up; null over nothing."""
    return F.when(whole > 0, F.floor(part.cast("double") / whole.cast("double") * 1000.0 + 0.5).cast("double") / 10.0)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text, as eight hexadecimal digits."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), F.floor(F.length(digits) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    units = F.transform(places, lambda i: F.conv(F.substr(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    mask = F.lit(0xFFFFFFFF).cast("long")
    value = F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(mask))
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def canonical_json(text: Column) -> Column:
    """A JSON text with the members of its objects in the order of their names, at every depth; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))
