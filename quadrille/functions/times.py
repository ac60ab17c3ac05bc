"""time: on typed results, times: on strings. Instants are read and shown in UTC."""

from __future__ import annotations

import time as clock

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille import terms
from quadrille.functions.registry import register
from quadrille.plans.values import Num, Val

_SHAPE = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?(Z|[-+]\d{1,2}:\d{2})?)?)?)?$"

# strftime codes and Java patterns: fixed values
_PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD",
    "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "h": "MMM", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy",
}


def instant(text: Column) -> Column:
    """Epoch seconds (double) of an ISO date or date and time; null for other text."""
    part = lambda k: F.regexp_extract(text, _SHAPE, k)
    filled = lambda k, default: F.when(part(k) == "", default).otherwise(part(k))
    day = F.concat_ws("-", part(1), filled(2, "01"), filled(3, "01"))
    days = F.datediff(day.try_cast("date"), F.lit("1970-01-01").cast("date"))
    seconds = filled(4, "0").try_cast("double") * 3600 + filled(5, "0").try_cast("double") * 60 + filled(6, "0").try_cast("double")
    zone = part(7)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(zone.isin("", "Z"), F.lit(0.0)).otherwise(
        sign * (F.regexp_extract(zone, r"(\d+):", 1).try_cast("double") * 3600 + F.regexp_extract(zone, r":(\d+)", 1).try_cast("double") * 60)
    )
    return F.when(F.regexp_like(text, F.lit(_SHAPE)), days * 86400.0 + seconds - offset)


def seconds_of(s: Val) -> Column:
    if s.kind == "time":
        return F.unix_micros(s.col) / 1e6
    return instant(s.lex())


def _stamp(seconds: Column) -> Column:
    return F.timestamp_seconds(F.floor(seconds))


def iso(seconds: Column) -> Column:
    return F.date_format(_stamp(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def java_pattern(fmt: str) -> str:
    """strftime notation as a Java pattern."""
    out, quoted, i = "", "", 0

    def flush() -> str:
        return "'" + quoted.replace("'", "''") + "'" if quoted else ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            code = fmt[i + 1]
            i += 2
            if code in _PATTERNS:
                out += flush() + _PATTERNS[code]
                quoted = ""
            elif code == "Z":
                quoted += "UTC"
            else:
                quoted += code
        else:
            quoted += fmt[i]
            i += 1
    return out + flush()


def _format(v: Val) -> str:
    if v.const is None:
        raise ValueError("time formats are constants")
    return java_pattern(terms.parts(v.const)[0])


def in_seconds(s: Val) -> Val:
    return Num(2, seconds_of(s)).val()


def from_seconds(o: Val) -> Val:
    return Val.text(iso(o.double()))


def _cut(start: int, size: int):
    return lambda s: F.substring(s.lex(), start, size)


def _field(start: int, size: int):
    def f(s: Val) -> Val:
        i = F.trim(_cut(start, size)(s)).try_cast("decimal(38,0)")
        return Num(0, i.cast("double"), i.cast("decimal(38,18)"), i).val()

    return f


def zone(s: Val) -> Val:
    found = F.regexp_extract(s.lex(), r".*([-+]\d{1,2}:\d{2})", 1)
    return Val.text(F.when(found != "", found))


def _weekday(s: Val) -> Column:
    """Monday is 0."""
    return F.pmod(F.floor(seconds_of(s) / 86400) + 3, F.lit(7))


def day_of_week(s: Val) -> Val:
    i = _weekday(s).cast("decimal(38,0)")
    return Num(0, i.cast("double"), i.cast("decimal(38,18)"), i).val()


def reformat(s: Val) -> Val:
    when, fmt = s.exact(2)
    return Val.text(F.date_format(_stamp(seconds_of(when)), _format(fmt)))


def now(local: bool):
    """The moment the plan is made, the same for every row of a run."""

    def f(s: Val) -> Val:
        fmt = terms.parts(s.const)[0] if s.const is not None and terms.kind(s.const) == "literal" else ""
        moment = clock.localtime() if local else clock.gmtime()
        return Val.text(F.lit(clock.strftime(fmt or "%Y-%m-%dT%H:%M:%SZ", moment)))

    return f


def format_seconds(s: Val) -> Val:
    seconds, fmt = s.exact(2)
    return Val.text(F.date_format(_stamp(seconds.double()), _format(fmt)))


def _parsed(s: Val) -> Column:
    text, fmt = s.exact(2)
    return F.unix_seconds(F.try_to_timestamp(text.lex(), F.lit(_format(fmt))))


def parse_to_seconds(s: Val) -> Val:
    i = _parsed(s).cast("decimal(38,0)")
    return Num(0, i.cast("double"), i.cast("decimal(38,18)"), i).val()


def parse(s: Val) -> Val:
    return Val.text(iso(_parsed(s)))


def _text(f):
    """The string twin of a function with a number for a result."""
    return lambda s: Val.text(F.regexp_replace(f(s).lex(), r"\.0$", ""))


FIELDS = {"year": (1, 4), "month": (6, 2), "day": (9, 2), "hour": (12, 2), "minute": (15, 2), "second": (18, 2)}

register("time:inSeconds", forward=in_seconds, reverse=from_seconds)
register("times:inSeconds", forward=lambda s: Val.text(seconds_of(s).cast("decimal(38,0)").cast("string")), reverse=from_seconds)
for _p in ("time", "times"):
    register(f"{_p}:equalTo", test=lambda s, o: seconds_of(s) == seconds_of(o))
    register(f"{_p}:date", forward=lambda s: Val.text(_cut(1, 10)(s)))
    register(f"{_p}:timeZone", forward=zone)
    register(f"{_p}:format", forward=reformat)
    register(f"{_p}:gmTime", forward=now(False))
    register(f"{_p}:localTime", forward=now(True))
    register(f"{_p}:formatSeconds", forward=format_seconds)
for _name, (_start, _size) in FIELDS.items():
    register(f"time:{_name}", forward=_field(_start, _size))
    register(f"times:{_name}", forward=lambda s, a=_start, b=_size: Val.text(_cut(a, b)(s)))
register("time:dayOfWeek", forward=day_of_week)
register("times:dayOfWeek", forward=_text(day_of_week))
register("time:parseToSeconds", forward=parse_to_seconds)
register("times:parseToSeconds", forward=_text(parse_to_seconds))
register("time:parse", forward=parse)
