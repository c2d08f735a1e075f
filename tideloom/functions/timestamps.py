"""Normalising timestamps of mixed formats and zones to UTC seconds, all in JVM expressions.

An ordered cascade of anchored patterns rewrites a value into canonical fields
`kind|year|month|day|hour|minute|second|am-pm|zone`; the first pattern that matches the whole value decides.
Fields are then validated strictly: nothing is rolled over (30 February, 24:61) and nothing is guessed.
Policies: a stated offset, zone abbreviation or absolute count wins over the default zone; a bracketed region after
an offset is only a comment; clock times that occur twice or never in their zone stay undetermined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names (English, German, French, Spanish, Italian, Dutch, Portuguese, Swedish).
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene gennaio januari janeiro",
    2: "february feb februar février févr fevrier febrero febbraio februari fevereiro",
    3: "march mar märz maerz mär mars marzo maart março",
    4: "april apr avril avr abril aprile",
    5: "may mai mayo maggio mei maio maj",
    6: "june jun juni juin junio giugno junho",
    7: "july jul juli juillet juil julio luglio julho",
    8: "august aug août aout agosto augustus augusti",
    9: "september sep sept septembre septiembre settembre setembro",
    10: "october oct oktober okt octobre octubre ottobre outubro",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez décembre déc decembre diciembre dicembre dezembro",
}
# Zone abbreviations in minutes east of UTC. Abbreviations with several meanings are left out.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "eat": 180, "npt": 345, "jst": 540, "aest": 600, "aedt": 660,
    "est": -300, "edt": -240, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?"
_ZONE = r"(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5})"
_TAIL = r"(?:\s*\[[^\]]*\]|\s*\([^)]*\))?"
_NAME = r"(\p{L}+)\.?"
_DOW = r"(?:\p{L}{2,10}\.?(?:,\s*|\s+))?"

#: (pattern, canonical fields); order matters, each pattern must match the whole trimmed value.
CASCADE: list[tuple[str, str]] = [
    # absolute counts: seconds, milliseconds, microseconds
    (r"^(\d{10})$", "epoch|$1|||||||"),
    (r"^(\d{10})\d{3}$", "epoch|$1|||||||"),
    (r"^(\d{10})\d{6}$", "epoch|$1|||||||"),
    # compact, with and without T
    (r"^(\d{4})(\d{2})(\d{2})[Tt]?(\d{2})(\d{2})(\d{2})(?:[.,]\d{1,9})?\s*(?:(?:" + _ZONE + ")" + _TAIL + r")?$", "ymd|$1|$2|$3|$4|$5|$6||$7"),
    (r"^(\d{4})(\d{2})(\d{2})$", "date|$1|$2|$3|0|0|0||"),
    # ISO 8601 and its relatives; ordinal dates
    (r"^(\d{4})-(\d{2})-(\d{2})(?:[Tt]|\s+)" + _TIME + r"\s*(?:" + _ZONE + _TAIL + ")?$", "ymd|$1|$2|$3|$4|$5|$6||$7"),
    (r"^(\d{4})-(\d{3})[Tt]" + _TIME + r"\s*(?:" + _ZONE + _TAIL + ")?$", "doy|$1||$2|$3|$4|$5||$6"),
    (r"^(\d{4})[-/](\d{2})[-/](\d{2})$", "date|$1|$2|$3|0|0|0||"),
    # all-numeric with the year last: order of day and month from the source
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2}),?\s+" + _TIME + r"\s*(?:" + _ZONE + _TAIL + ")?$", "dot|$3|$2|$1|$4|$5|$6||$7"),
    (r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2}),?\s+" + _TIME + r"(?:\s*([AaPp])\.?[Mm]\.?)?\s*(?:" + _ZONE + _TAIL + ")?$", "num|$3|$2|$1|$4|$5|$6|$7|$8"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "dotdate|$3|$2|$1|0|0|0||"),
    # named months
    (r"^" + _TIME + r",\s+(\d{1,2})\.?\s+" + _NAME + r"\s+(\d{4})\s*(?:\(?" + _ZONE + r"\)?)?$", "ymd|$6|$5|$4|$1|$2|$3||$7"),
    (r"^" + _DOW + r"(\d{1,2})\.?\s+" + _NAME + r"\s+(\d{4}),?\s+" + _TIME + r"(?:\s+[Uu]hr)?\s*(?:" + _ZONE + _TAIL + ")?$", "ymd|$3|$2|$1|$4|$5|$6||$7"),
    (r"^" + _DOW + _NAME + r"\s+(\d{1,2}),\s+(\d{4})(?:,|\s+at)?\s+" + _TIME + r"(?:\s*([AaPp])\.?[Mm]\.?)?\s*(?:" + _ZONE + _TAIL + ")?$", "ymd|$3|$1|$2|$4|$5|$6|$7|$8"),
    (r"^\p{L}{2,4}\.?,?\s+" + _NAME + r"\s+(\d{1,2})\s+" + _TIME + r"(?:\s+" + _ZONE + r")?\s+(\d{4})$", "ymd|$7|$1|$2|$3|$4|$5||$6"),
    (r"^(\d{1,2})\.?\s+" + _NAME + r"\s+(\d{4})$", "date|$3|$2|$1|0|0|0||"),
    (r"^" + _NAME + r"\s+(\d{1,2}),\s+(\d{4})$", "date|$3|$1|$2|0|0|0||"),
]


def known_zones(spark: SparkSession) -> list[str]:
    """Region names the JVM knows; any other name would be an error inside a query."""
    listed = spark._jvm.java.time.ZoneId.getAvailableZoneIds().toString()
    return sorted(z.strip() for z in listed.strip("[]").split(","))


def _lit(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else '"' + text + '"'


def _map(pairs: dict) -> str:
    return "map(" + ", ".join(f"'{k}', {v}" for k, v in pairs.items()) + ")"


def _civil(y: str, m: str, d: str) -> str:
    """Seconds of midnight as if the clock ran on UTC; null where the date doesn't exist. No session zone is used."""
    day = f"CAST(try_make_timestamp_ntz({y}, {m}, {d}, 0, 0, 0) AS DATE)"
    return f"CAST(datediff({day}, DATE'1970-01-01') AS BIGINT) * 86400"


def _local(u: str) -> str:
    return f"unix_seconds(from_utc_timestamp(timestamp_seconds({u}), _home))"


def with_instant(df: DataFrame, value: str, zone: str, order: str = "CAST(NULL AS STRING)", bare_dates: bool = False) -> DataFrame:
    """Adds utc_s (bigint) and status (string); value, zone and order are SQL expressions over df.

    zone: default region of the source, null if unknown; order: DMY or MDY, null if unknown (then an all-numeric date
    counts only if both readings agree or one is impossible; dotted dates are DMY). Status is ok, missing, unparsed,
    incomplete, impossible, unknown_zone, ambiguous or nonexistent; utc_s is null for all but ok. Fractions are cut off.
    
    """
    keep = [f"`{c}`" for c in df.columns]
    months = _map({name: k for k, names in MONTHS.items() for name in names.split()})
    abbr = _map({k: m * 60 for k, m in ABBREVIATIONS.items()})
    zones = ", ".join(f"'{z}'" for z in known_zones(df.sparkSession))
    ws = r"^[\s\u00a0\u200b\ufeff]+|[\s\u00a0\u200b\ufeff]+$"
    cascade = " ".join(f"WHEN _v RLIKE {_lit(p)} THEN regexp_replace(_v, {_lit(p)}, '{to}')" for p, to in CASCADE)
    number = lambda x: f"try_cast({x} AS INT)"
    steps = [
        [f"{value} AS _raw", f"regexp_replace({value}, {_lit(ws)}, '') AS _v", f"CASE WHEN {zone} IN ({zones}) THEN {zone} END AS _home", f"{order} AS _order"],
        ["_raw", "_home", "_order", f"split(CASE {cascade} END, '[|]') AS _f"],
        ["_raw", "_home", "_order", "_f[0] AS _kind", f"{number('_f[1]')} AS _yy", "length(_f[1]) AS _ylen", "_f[1] AS _count", f"coalesce({number('_f[2]')}, try_element_at({months}, lower(_f[2]))) AS _m",
         f"{number('_f[3]')} AS _d", f"{number('_f[4]')} AS _hh", f"{number('_f[5]')} AS _mi", f"coalesce({number('_f[6]')}, 0) AS _s", "lower(_f[7]) AS _ap", "nullif(_f[8], '') AS _z"],
        ["_raw", "_home", "_order", "_kind", "_count", "_m", "_d", "_z", "CASE WHEN _ylen = 2 THEN _yy + CASE WHEN _yy < 70 THEN 2000 ELSE 1900 END ELSE _yy END AS _y",
         "CASE WHEN _ap = '' AND _hh BETWEEN 0 AND 23 OR _ap <> '' AND _hh BETWEEN 1 AND 12 THEN CASE WHEN _mi BETWEEN 0 AND 59 AND _s BETWEEN 0 AND 59 THEN CASE WHEN _ap = '' THEN _hh WHEN _ap = 'p' THEN _hh % 12 + 12 ELSE _hh % 12 END * 3600 + _mi * 60 + _s END END AS _time",
         f"CASE WHEN _z RLIKE '^[+-]' THEN regexp_replace(_z, '[^0-9]', '') END AS _digits"],
        ["_raw", "_home", "_order", "_kind", "_count", "_z", "_time", "_y", "_d", f"CASE WHEN _kind <> 'doy' THEN {_civil('_y', '_m', '_d')} END AS _dmy", f"CASE WHEN _kind IN ('num', 'dot') THEN {_civil('_y', '_d', '_m')} END AS _mdy",
         f"CASE WHEN _kind = 'doy' AND _d BETWEEN 1 AND CASE WHEN _y % 4 = 0 AND _y % 100 <> 0 OR _y % 400 = 0 THEN 366 ELSE 365 END THEN {_civil('_y', '1', '1')} + (_d - 1) * 86400 END AS _doy",
         f"CASE WHEN _digits IS NULL THEN try_element_at({abbr}, lower(_z)) WHEN CAST(substr(_digits, 1, 2) AS INT) <= 14 AND coalesce({number('substr(_digits, 3, 2)')}, 0) < 60 THEN (CAST(substr(_digits, 1, 2) AS INT) * 3600 + coalesce({number('substr(_digits, 3, 2)')}, 0) * 60) * CASE WHEN _z LIKE '-%' THEN -1 ELSE 1 END END AS _off"],
        ["_raw", "_home", "_kind", "_count", "_z", "_off", """_time + CASE WHEN _kind NOT IN ('num', 'dot') THEN coalesce(_dmy, _doy) WHEN _order = 'DMY' THEN _dmy WHEN _order = 'MDY' THEN _mdy WHEN _kind = 'dot' THEN _dmy
            WHEN _dmy IS NULL OR _dmy = _mdy THEN _mdy WHEN _mdy IS NULL THEN _dmy END AS _c"""],
        ["_raw", "_home", "_kind", "_count", "_z", "_off", "_c", f"_c - ({_local('_c - 86400')} - (_c - 86400)) AS _b", f"_c - ({_local('_c + 86400')} - (_c + 86400)) AS _a"],
        ["_raw", "_home", "_kind", "_count", "_z", "_off", "_c", "_b", "_a", f"{_local('_b')} = _c AS _okb", f"{_local('_a')} = _c AS _oka"],
        [f"""CASE WHEN _raw IS NULL THEN 'missing' WHEN _kind IS NULL THEN 'unparsed' WHEN _kind = 'epoch' THEN 'ok' WHEN _kind IN ('date', 'dotdate') AND NOT {bare_dates} THEN 'incomplete' WHEN _c IS NULL THEN 'impossible'
            WHEN _z IS NOT NULL THEN CASE WHEN _off IS NULL THEN 'unknown_zone' ELSE 'ok' END WHEN _home IS NULL THEN 'unknown_zone' WHEN _okb AND _oka AND _b <> _a THEN 'ambiguous' WHEN _okb OR _oka THEN 'ok' ELSE 'nonexistent' END AS status""",
         "CASE WHEN _kind = 'epoch' THEN try_cast(_count AS BIGINT) WHEN _z IS NOT NULL THEN _c - _off WHEN _okb THEN _b WHEN _oka THEN _a END AS _u"],
    ]
    # Each step is a struct built from the struct before it by a lambda over an array of one: every field is computed
    # once, and no filter that is pushed down later can inline the chain into an exponentially large expression.
    chain = ""
    for k, step in enumerate(steps):
        fields = ", ".join(f"'{name}', {expr}" for expr, name in (item.rsplit(" AS ", 1) if " AS " in item else (item, item) for item in step))
        if not k:
            chain = f"array(named_struct({fields}))"
        else:
            bound = re.sub(r"(?<![\w'])_[a-z]+(?![\w'])", lambda m: "s." + m[0], re.sub(r"'(_\w+)'", r"'\1'", fields))
            chain = f"transform({chain}, s -> named_struct({bound}))"
    last = f"transform({chain}, s -> named_struct('utc_s', CASE WHEN s.status = 'ok' THEN s._u END, 'status', s.status))"
    return df.selectExpr(*keep, f"inline({last})")


def iso_utc(utc_s: Column) -> Column:
    """2018-03-05T07:09:11Z of UTC seconds, independent of the session zone."""
    rest = F.pmod(utc_s, F.lit(86400))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor(utc_s / 86400).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def compact_utc(value: str) -> Column:
    """UTC seconds of a 14-digit UTC stamp (a SQL expression), null if it isn't exactly that or doesn't exist."""
    n = lambda a, b: f"CAST(substr({value}, {a}, {b}) AS INT)"
    time = f"CASE WHEN {n(9, 2)} < 24 AND {n(11, 2)} < 60 AND {n(13, 2)} < 60 THEN {n(9, 2)} * 3600 + {n(11, 2)} * 60 + {n(13, 2)} END"
    return F.expr(f"CASE WHEN {value} RLIKE '^[0-9]{{14}}$' THEN {_civil(n(1, 4), n(5, 2), n(7, 2))} + {time} END")
