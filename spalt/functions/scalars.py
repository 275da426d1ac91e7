"""Canonical text forms of business scalars, so that equal values are equal strings. NULL stays NULL; a wrong text is an error.

Texts, dates, times and zoned times are column expressions. JSON, network addresses and intervals need a parser each; a
pandas UDF gives it the distinct texts of each Arrow batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds whose canonical texts sort as their values do; the others have equality alone.
ORDERED = ("time", "timetz", "timestamptz", "uuid", "macaddr", "date", "timestamp")


def _shaped(x: Column, pattern: str, form: Callable[[Column], Column], what: str) -> Column:
    return F.when(x.isNull(), F.lit(None).cast("string")).when(x.rlike(pattern), form(x)).otherwise(F.raise_error(F.concat(F.lit(f"invalid {what}: "), x)).cast("string"))


def uuid(x: Column) -> Column:
    h = "[0-9a-fA-F]"
    return _shaped(x, rf"\A{h}{{8}}-{h}{{4}}-{h}{{4}}-{h}{{4}}-{h}{{12}}\z", F.lower, "UUID")


def macaddr(x: Column) -> Column:
    h = "[0-9a-fA-F]{2}"
    return _shaped(x, rf"\A{h}([:-]){h}(\1{h}){{4}}\z", lambda c: F.lower(F.regexp_replace(c, "-", ":")), "MAC address")


def date(x: Column) -> Column:
    return _shaped(x, r"\A\d{4}-\d{2}-\d{2}\z", lambda c: c, "date, which must look like YYYY-MM-DD")


def timestamp(x: Column) -> Column:
    return _shaped(x, r"\A\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\z", lambda c: c, "timestamp")


def time(x: Column) -> Column:
    def form(c: Column) -> Column:
        parts = F.split(c, r"\.")
        return F.concat(parts[0], F.lit("."), F.rpad(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), 6, "0"))

    return _shaped(x, r"\A([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?\z", form, "time")


_ZONED_TIME = r"((?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d)(?:\.(\d{1,6}))?([Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)"
_DAY = 86_400 * 10**6


def _number(text: Column) -> Column:
    return text.cast("bigint")


def _utc_micros(x: Column, pattern: str, first: int) -> Column:
    """Microseconds from the day's midnight in UTC, below 0 or beyond a day where the zone says so; the groups of a zoned time begin at `first`."""
    group = lambda i: F.regexp_extract(x, pattern, first + i)
    clock, zone = group(0), group(2)
    part = lambda text, at: _number(F.substring(text, at, 2))
    seconds = (part(clock, 1) * 60 + part(clock, 4)) * 60 + part(clock, 7)
    offset = F.when(F.upper(zone) == "Z", F.lit(0).cast("bigint")).otherwise((part(zone, 2) * 60 + part(zone, 5)) * 60 * F.when(zone.startswith("-"), -1).otherwise(1))
    return (seconds - offset) * 10**6 + _number(F.rpad(group(1), 6, "0"))


def _clock(micros: Column) -> Column:
    """HH:MM:SS.ffffffZ of microseconds in a day."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    seconds = F.floor(micros / 10**6)
    return F.concat(two(F.floor(seconds / 3600)), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60), F.lit("."), F.lpad((micros % 10**6).cast("string"), 6, "0"), F.lit("Z"))


def _zoned(x: Column, pattern: str, form: Callable[[Column], Column], what: str) -> Column:
    """form, which is NULL for a text that has the shape but no meaning."""
    bad = F.raise_error(F.concat(F.lit(f"invalid {what}: "), x)).cast("string")
    known = x.rlike(rf"\A{pattern}\z") & ~x.endswith("-00:00")
    return F.when(x.isNull(), F.lit(None).cast("string")).when(known, F.coalesce(form(x), bad)).otherwise(bad)


def timetz(x: Column) -> Column:
    """A time with its zone, as the time in UTC."""
    return _zoned(x, _ZONED_TIME, lambda c: _clock(F.pmod(_utc_micros(c, _ZONED_TIME, 1), F.lit(_DAY))), "TIMETZ")


def timestamptz(x: Column) -> Column:
    """A timestamp with its zone, as that in UTC; whatever the session's zone is."""
    pattern = rf"(\d{{4}}-\d{{2}}-\d{{2}})[Tt]{_ZONED_TIME}"

    def form(c: Column) -> Column:
        micros = _utc_micros(c, pattern, 2)
        day = F.regexp_extract(c, pattern, 1).try_cast("date")
        at = F.date_add(day, F.floor(micros / _DAY).cast("int"))
        return F.when(F.year(at).between(1000, 9999), F.concat(at.cast("string"), F.lit("T"), _clock(F.pmod(micros, F.lit(_DAY)))))

    return _zoned(x, pattern, form, "TIMESTAMPTZ")


def json_number(text: str) -> str:
    """The exact value: an integer as it is, up to 1024 zeros; else a point behind up to seven digits, or one digit and an exponent."""
    sign, digits, exponent = Decimal(text).as_tuple()
    shown = "".join(map(str, digits)).lstrip("0")
    full = len(shown)
    shown = shown.rstrip("0")
    exponent += full - len(shown)
    if not shown:
        return "0"
    point = len(shown) + exponent
    if 0 <= exponent <= 1024:
        body = shown + "0" * exponent
    elif exponent < 0 and 0 <= point <= 7:
        body = f"{shown[:point] or '0'}.{shown[point:]}"
    else:
        body = f"{shown[0]}.{shown[1:] or '0'}e{point - 1}"
    return "-" * sign + body


_ESCAPED = re.compile(r'[\x00-\x1f"\\]')
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(text: str) -> str:
    return '"' + _ESCAPED.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


def canonical_json(text: str) -> str:
    """Keys in order, the first of repeated keys, every number exact and in one form."""

    class Number(str):
        pass

    def first(pairs: list) -> dict:
        out: dict = {}
        for k, v in pairs:
            out.setdefault(k, v)
        return out

    def refuse(word: str):
        raise ValueError(f"not JSON: {word}")

    def show(v) -> str:
        if isinstance(v, Number):
            return json_number(v)
        if isinstance(v, str):
            return json_string(v)
        if isinstance(v, list):
            return "[" + ",".join(map(show, v)) + "]"
        if isinstance(v, dict):
            return "{" + ",".join(f"{json_string(k)}:{show(v[k])}" for k in sorted(v)) + "}"
        return {None: "null", True: "true", False: "false"}[v]

    try:
        out = show(json.loads(text, object_pairs_hook=first, parse_float=Number, parse_int=Number, parse_constant=refuse))
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    out.encode()  # half of a surrogate pair is no text
    return out


def _ipv4(text: str) -> int | None:
    parts = text.split(".")
    if len(parts) != 4 or not all(re.fullmatch(r"0|[1-9][0-9]{0,2}", p) and int(p) < 256 for p in parts):
        return None
    return sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts))


def _ipv6(text: str) -> int | None:
    head, gap, tail = text.partition("::")
    if "::" in tail:
        return None

    def groups(part: str, last: bool) -> list[int] | None:
        out: list[int] = []
        for i, g in enumerate(items := part.split(":") if part else []):
            if "." in g and last and i == len(items) - 1 and (v := _ipv4(g)) is not None:
                out += [v >> 16, v & 0xFFFF]
            elif re.fullmatch(r"[0-9a-fA-F]{1,4}", g):
                out.append(int(g, 16))
            else:
                return None
        return out

    a, b = groups(head, not gap), groups(tail, True)
    if a is None or b is None or (len(a) + len(b) > 7 if gap else len(a) != 8):
        return None
    full = a + [0] * (8 - len(a) - len(b)) + b
    return sum(g << 16 * (7 - i) for i, g in enumerate(full))


def _show(value: int, bits: int) -> str:
    if bits == 32:
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    return ":".join(f"{value >> 16 * i & 0xFFFF:04x}" for i in range(7, -1, -1))


def _address(text: str) -> tuple[int, int]:
    for parse, bits in ((_ipv4, 32), (_ipv6, 128)):
        if (v := parse(text)) is not None:
            return v, bits
    raise ValueError("bad address")


def canonical_inet(text: str) -> str:
    """An address, without the length of a network."""
    return _show(*_address(text))


def canonical_cidr(text: str) -> str:
    """A network: an address without host bits, and its length."""
    host, _, length = text.partition("/")
    if not re.fullmatch(r"[0-9]{1,3}", length):
        raise ValueError("a network has a length")
    (value, bits), n = _address(host), int(length)
    if n > bits or value & ((1 << bits - n) - 1):
        raise ValueError("a network has no host bits")
    return f"{_show(value, bits)}/{n}"


_INTERVAL = re.compile(r"([+-]?)P(?:(\d{1,18})Y)?(?:(\d{1,18})M)?(?:(\d{1,18})W)?(?:(\d{1,18})D)?(T(?:(\d{1,18})H)?(?:(\d{1,18})M)?(?:(\d{1,18})(?:\.(\d{1,6}))?S)?)?", re.ASCII)


def canonical_interval(text: str) -> str:
    """Months, days and seconds to six places, one sign before all; weeks stand alone, months are of no fixed length."""
    m = _INTERVAL.fullmatch(text)
    if not m or m[6] == "T" or not any(m.groups()[1:]) or (m[4] and any(m[i] for i in (2, 3, 5, 6))):
        raise ValueError("bad interval")
    years, months, weeks, days, hours, minutes, seconds = (int(m[i] or 0) for i in (2, 3, 4, 5, 7, 8, 9))
    calendar = years * 12 + months
    whole, micros = divmod(((hours * 60 + minutes) * 60 + seconds) * 10**6 + int((m[10] or "").ljust(6, "0")) + (weeks * 7 + days) * _DAY, _DAY)
    sign = "-" if m[1] == "-" and (calendar or whole or micros) else ""
    return f"{sign}P{calendar}M{whole}DT{micros // 10**6}.{micros % 10**6:06d}S"


def _udf(form: Callable[[str], str], what: str) -> Callable[[Column], Column]:
    def one(x):
        try:
            return form(x)
        except (ValueError, OverflowError) as e:
            raise ValueError(f"invalid {what}: {x}") from e

    def many(s: pd.Series) -> pd.Series:
        made = {x: one(x) for x in s.dropna().unique()}
        return pd.Series([made.get(x) for x in s], dtype=object)

    many.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(many, T.StringType())


json_text = _udf(canonical_json, "JSON")
inet = _udf(canonical_inet, "INET")
cidr = _udf(canonical_cidr, "CIDR")
interval = _udf(canonical_interval, "INTERVAL")
