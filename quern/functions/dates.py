"""Date and time functions with the reference's conventions: Sunday is 0, weeks begin on Monday, spans are boundary counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
_MONTHS = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200, "millennium": 12000}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a date or timestamp (UTC)."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def dow(ts) -> Column:
    """0 is Sunday."""
    return F.dayofweek(_c(ts)) - 1


def isodow(ts) -> Column:
    """1 is Monday, 7 Sunday."""
    return F.weekday(_c(ts)) + 1


def isoyear(ts) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _c(ts))


def yearweek(ts) -> Column:
    return isoyear(ts) * 100 + F.weekofyear(_c(ts))


def decade(ts) -> Column:
    return F.floor(F.year(_c(ts)) / 10).cast("long")


def century(ts) -> Column:
    y = F.year(_c(ts))
    return F.when(y > 0, F.floor((y - 1) / 100) + 1).otherwise(F.floor(y / 100)).cast("long")


def millennium(ts) -> Column:
    y = F.year(_c(ts))
    return F.when(y > 0, F.floor((y - 1) / 1000) + 1).otherwise(F.floor(y / 1000)).cast("long")


def era(ts) -> Column:
    return F.when(F.year(_c(ts)) > 0, 1).otherwise(0)


def julian(ts) -> Column:
    """Days since -4712-01-01, midnight based."""
    return micros(ts) / _MICROS["day"] + 2_440_588


def epoch(ts) -> Column:
    return micros(ts) / 1e6


def epoch_ms(ts) -> Column:
    """Rounded to the nearest."""
    return F.floor((micros(ts) + 500) / 1000).cast("long")


def epoch_us(ts) -> Column:
    return micros(ts)


def epoch_ns(ts) -> Column:
    return micros(ts) * 1000


def millisecond(ts) -> Column:
    """With the seconds."""
    return F.floor((micros(ts) % _MICROS["minute"]) / 1000).cast("long")


def microsecond(ts) -> Column:
    """With the seconds."""
    return (micros(ts) % _MICROS["minute"]).cast("long")


def date_trunc(part: str, ts) -> Column:
    """Truncated, as a timestamp without zone."""
    if part in ("decade", "century", "millennium"):
        years = _MONTHS[part] // 12
        first = F.floor(F.year(_c(ts)) / years) * years
        return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_trunc(part, _c(ts)).cast("timestamp_ntz")


def months(ts) -> Column:
    return F.year(_c(ts)) * 12 + F.month(_c(ts)) - 1


def date_diff(part: str, a, b) -> Column:
    """Boundaries of the part crossed from a to b; weeks are whole sevens of day boundaries."""
    if part in _MONTHS:
        step = _MONTHS[part]
        return (F.floor(months(b) / step) - F.floor(months(a) / step)).cast("long")
    if part == "week":
        return F.call_function("div", date_diff("day", a, b), F.lit(7).cast("long")).cast("long")
    step = _MICROS[part]
    return (F.floor(micros(b) / step) - F.floor(micros(a) / step)).cast("long")


def date_sub(part: str, a, b) -> Column:
    """Whole parts from a to b."""
    if part in _MONTHS:
        inside = [micros(x) - F.unix_micros(F.date_trunc("month", _c(x))) for x in (a, b)]
        m = months(b) - months(a)
        m = m - F.when((m > 0) & (inside[1] < inside[0]), 1).otherwise(0) + F.when((m < 0) & (inside[1] > inside[0]), 1).otherwise(0)
        return F.call_function("div", m.cast("long"), F.lit(_MONTHS[part]).cast("long")).cast("long")
    span = micros(b) - micros(a)
    return F.call_function("div", span, F.lit(_MICROS[part]).cast("long")).cast("long")


def time_bucket(width: str, count: int, ts) -> Column:
    """Start of the bucket of count parts: from Monday 2000-01-03 for parts up to weeks, from 2000-01-01 for months and more."""
    if width in _MONTHS:
        step, origin = _MONTHS[width] * count, 2000 * 12
        first = F.floor((months(ts) - origin) / step) * step + origin
        return F.make_date(F.floor(first / 12).cast("int"), (first % 12 + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
    step, origin = _MICROS[width] * count, 946_857_600_000_000
    return from_micros(micros(ts) - F.pmod(micros(ts) - origin, F.lit(step)))


#: Strftime letters and their Java patterns.
_FORMATS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "-d": "d", "-m": "M", "-H": "H", "g": "SSS", "%": "%"}


def java_format(pattern: str) -> str:
    """strftime format to Java date pattern."""
    out, quoted, i = "", "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "%":
            key = pattern[i + 1 : i + 3] if pattern[i + 1] == "-" else pattern[i + 1]
            if quoted:
                out, quoted = out + ("'" + quoted.replace("'", "''") + "'" if quoted.strip(" -:/.,") else quoted), ""
            out += _FORMATS[key]
            i += 1 + len(key)
        else:
            quoted += c
            i += 1
    if quoted:
        out += "'" + quoted.replace("'", "''") + "'" if quoted.strip(" -:/.,") else quoted
    return out


def strftime(ts, pattern: str) -> Column:
    return F.date_format(_c(ts), java_format(pattern))


def strptime(s, *patterns: str, strict: bool = True) -> Column:
    """The first pattern that fits; none raises, or gives null where not strict."""
    tried = F.coalesce(*[F.try_to_timestamp(_c(s), F.lit(java_format(p))) for p in patterns]).cast("timestamp_ntz")
    if not strict:
        return tried
    return F.when(_c(s).isNull() | tried.isNotNull(), tried).otherwise(F.raise_error(F.lit("no format fits")).cast("timestamp_ntz"))


def interval_text(years: Column, months_: Column, days: Column) -> Column:
    """An interval as text, parts that are zero left out."""
    def part(n: Column, unit: str) -> Column:
        return F.when(n != 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(F.abs(n) == 1, "").otherwise("s")))

    return F.concat_ws(" ", part(years, "year"), part(months_, "month"), part(days, "day"))


def age(a, b) -> Column:
    """a - b in years, months and days, as text; whole days, and days that are short borrow the month of the earlier date."""
    early, late = [f(_c(a).cast("timestamp_ntz"), _c(b).cast("timestamp_ntz")) for f in (F.least, F.greatest)]
    sign = F.when(_c(a) < _c(b), -1).otherwise(1)
    clock = [micros(x) - micros(F.date_trunc("day", x)) for x in (early, late)]
    days = F.dayofmonth(late) - F.dayofmonth(early) - F.when(clock[1] < clock[0], 1).otherwise(0)
    whole = months(late) - months(early) - F.when(days < 0, 1).otherwise(0)
    days = days + F.when(days < 0, F.dayofmonth(F.last_day(early))).otherwise(0)
    text = interval_text(sign * F.floor(whole / 12), sign * (whole % 12), sign * days)
    return F.when(_c(a).isNotNull() & _c(b).isNotNull(), text)


def to_interval(n, part: str) -> Column:
    """An interval of n parts, to add to dates; it cannot leave a plan as a value."""
    scale = {"decades": ("years", 10), "centuries": ("years", 100), "millennia": ("years", 1000), "quarters": ("months", 3), "minutes": ("mins", 1), "seconds": ("secs", 1)}
    name, times = scale.get(part, (part, 1))
    return F.make_interval(**{name: _c(n) * times})


def dayname(ts) -> Column:
    return F.date_format(_c(ts), "EEEE")


def monthname(ts) -> Column:
    return F.date_format(_c(ts), "MMMM")
