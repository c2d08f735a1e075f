"""Dates in running text and what is derived from them: single dates, ranges, partial dates, spans, cell states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full month names, as the texts have them.
ENGLISH = "january february march april may june july august september october november december".split()
FRENCH = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()

# Forms of single dates (pattern, group of year or 0 for the year of the context, month, day), in order of trust.
SINGLE = [
    (r"\b(\d{4})-(\d{2})-(\d{2})\b", 1, 2, 3),
    (r"({m})\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", 3, 1, 2),
    (r"(\d{1,2})(?:st|nd|rd|th)?\s+({m})\s+(\d{4})", 3, 2, 1),
    (r"(\d{1,2})\s+({m})(?!\s*\d{3})", 0, 2, 1),
    (r"({m})\s+(\d{1,2})(?:st|nd|rd|th)?(?!\s*,?\s*\d{3})", 0, 1, 2),
]
# Forms of ranges (pattern, year, month and day of the start, month and day of the end); a second month group counts if present.
RANGES = [
    (r"(\d{1,2})\s*[–\-—]\s*(\d{1,2})\s+({m})\s+(\d{4})", 4, (3,), 1, (3,), 2),
    (r"({m})\s+(\d{1,2})\s*[–\-—]\s*(\d{1,2}),?\s+(\d{4})", 4, (1,), 2, (1,), 3),
    (r"(\d{1,2})\s+to\s+(\d{1,2})\s+({m})\s+(\d{4})", 4, (3,), 1, (3,), 2),
    (r"({m})\s+(\d{1,2})\s+to\s+(\d{1,2}),?\s+(\d{4})", 4, (1,), 2, (1,), 3),
    (r"({m})\s+(\d{1,2})(?:st|nd|rd|th)\s+to\s+(\d{1,2})(?:st|nd|rd|th),?\s+(\d{4})", 4, (1,), 2, (1,), 3),
    (r"({m})\s+(\d{1,2}),?\s+(\d{4})\s+to\s+(?:{m})\s+(\d{1,2})", 3, (1,), 2, (1,), 4),
    (r"(\d{1,2})(?:st|nd|rd|th)\s+to\s+(\d{1,2})(?:st|nd|rd|th)\s+of\s+({m})\s+(\d{4})", 4, (3,), 1, (3,), 2),
    (r"({m})\s+(\d{1,2})\s+through\s+(?:\w+,\s+)?(?:{m})\s+(\d{1,2})(?:,\s+(\d{4}))?", 4, (1,), 2, (1,), 3),
    (r"du\s+(\d{1,2})\s+(?:({m})\s+)?au\s+(\d{1,2})\s+({m})\s+(\d{4})", 5, (2, 4), 1, (4,), 3),
]


def _pattern(p: str, months: list[str]) -> str:
    return "(?iu)" + p.replace("{m}", "|".join(months))


def _month(name: Column) -> Column:
    """Two digits of a month name or number."""
    table = F.create_map(*[F.lit(x) for names in (ENGLISH, FRENCH) for k, n in enumerate(names, 1) for x in (n, f"{k:02d}")])
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.lpad(name, 2, "0"))


def _plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&ndash;"), F.lit("–")), F.lit("&mdash;"), F.lit("—"))


def _group(text: Column, pattern: str, *ks: int) -> Column:
    """The first group that took part, null if none did."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in ks])


def first_date(text: Column, context_year: Column) -> Column:
    """Struct (date, confidence) of the first form that occurs: ISO, month day year, day month year (confirmed), then without a
    year, taken from the context (approximate). Month names are English and in full. Null text or no date: null and unknown.
    The parts are taken as written; whether such a day exists is not asked."""
    t = _plain(text)

    def form(p: str, y: int, m: int, d: int) -> Column:
        p = _pattern(p, ENGLISH)
        year = _group(t, p, y) if y else context_year.cast("string")
        iso = F.concat_ws("-", F.lpad(year, 4, "0") if not y else year, _month(_group(t, p, m)), F.lpad(_group(t, p, d), 2, "0"))
        return F.when(t.rlike(p) & year.isNotNull(), F.struct(iso.alias("date"), F.lit("confirmed" if y else "approximate").alias("confidence")))

    none = F.struct(F.lit(None).cast("string").alias("date"), F.lit("unknown").alias("confidence"))
    return F.coalesce(*[form(*f) for f in SINGLE], none)


def date_range(text: Column, context_year: Column) -> Column:
    """Struct (start, end, confidence) of a range in English or French: of all matches, in the order of the forms, the first of the
    context's year, else the first. Only a month with that year: null dates, approximate; else unknown."""
    t, year, months = _plain(text), context_year.cast("string"), ENGLISH + FRENCH

    def every(p: str, y: int, m1: tuple, d1: int, m2: tuple, d2: int) -> Column:
        p = _pattern(p, months)

        def one(x: Column) -> Column:
            yy = F.coalesce(_group(x, p, y), year)
            iso = lambda m, d: F.concat_ws("-", yy, _month(_group(x, p, *m)), F.lpad(_group(x, p, d), 2, "0"))
            return F.struct(iso(m1, d1).alias("start"), iso(m2, d2).alias("end"), yy.alias("year"))

        return F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), one)

    found = reduce(F.concat, [every(*f) for f in RANGES])
    wanted = F.filter(found, lambda x: x.year == year)
    best = F.coalesce(F.get(wanted, F.lit(0)), F.get(found, F.lit(0)))
    month_only = F.coalesce(F.regexp_like(t, F.concat(F.lit(_pattern(r"({m})\s+", months)), year)), F.lit(False))
    nothing = F.lit(None).cast("string")
    sure = F.struct(best["start"].alias("start"), best["end"].alias("end"), F.lit("confirmed").alias("confidence"))
    other = F.struct(nothing.alias("start"), nothing.alias("end"), F.when(month_only, "approximate").otherwise("unknown").alias("confidence"))
    return F.when(best.isNotNull(), sure).otherwise(other)


def partial_equal(a: Column, b: Column) -> Column:
    """Dates of different precision agree if the shorter is a prefix of the longer (year-month or full)."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n.isin(7, 10), F.substring(a, 1, 10).substr(F.lit(1), n) == F.substring(b, 1, 10).substr(F.lit(1), n)).otherwise(False)


def settle_month(date: Column, confidence: Column) -> Column:
    """Struct (date, confidence): a month becomes its first day and is approximate; anything else stays."""
    month = F.coalesce(date.rlike(r"^\d{4}-\d{2}$"), F.lit(False))
    return F.struct(F.when(month, F.concat(date, F.lit("-01"))).otherwise(date).alias("date"), F.when(month, "approximate").otherwise(confidence).alias("confidence"))


def _day(date: Column) -> Column:
    """The day of a full date, the first of a month; null for anything else."""
    return F.when(date.rlike(r"^\d{4}-\d{2}$"), F.concat(date, F.lit("-01"))).when(date.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(date, 1, 10)).try_cast("date")


def show_date(date: Column, confidence: Column) -> Column:
    """dd/mm, or mm/yy of a month, ~ before an approximate one; a dash without a date or if it does not apply, ? if unknown, the text itself if it is no date."""
    d = _day(date)
    month = date.rlike(r"^\d{4}-\d{2}$")
    label = F.when(month, F.concat(F.substring(date, 6, 2), F.lit("/"), F.substring(date, 3, 2))).when(d.isNotNull(), F.date_format(d, "dd/MM"))
    shown = F.coalesce(F.concat(F.when(confidence == "approximate", "~").otherwise(""), label), F.substring(date, 1, 10))
    return F.when(date.isNull() | (date == "") | F.coalesce(confidence == "not_applicable", F.lit(False)), "—").when(confidence == "unknown", "?").otherwise(shown)


def days_open(start: Column, start_state: Column, end: Column, end_state: Column, extended: Column, extended_state: Column) -> Column:
    """Days from the opening to the last deadline, the extended one if it is set: `12d`, `~12d` if either is approximate, a dash if
    either does not apply, ? if either is unknown, no day, or the span would be negative."""
    state = lambda c: F.coalesce(c, F.lit("unknown"))
    longer = ~state(extended_state).isin("not_applicable", "unknown") & extended.isNotNull()
    last, last_state = F.when(longer, extended).otherwise(end), F.when(longer, state(extended_state)).otherwise(state(end_state))
    n = F.datediff(_day(last), _day(start))
    first_state = state(start_state)
    rough = F.when((first_state == "approximate") | (last_state == "approximate"), "~").otherwise("")
    return (
        F.when(first_state == "not_applicable", "—").when(first_state == "unknown", "?").when(last_state == "not_applicable", "—").when(last_state == "unknown", "?")
        .when(n.isNull() | (n < 0), "?").otherwise(F.concat(rough, n.cast("string"), F.lit("d")))
    )


def cell_state(date: Column, confidence: Column) -> Column:
    """Code of a table cell: not_applicable, confirmed or approximate (with a date), else unknown."""
    return F.when(confidence == "not_applicable", "not_applicable").when(confidence.isin("confirmed", "approximate") & date.isNotNull(), confidence).otherwise("unknown")


def verdict(stored: Column, found: Column, earlier: Column, noted_only: Column) -> Column:
    """Outcome of checking a stored date against the one found in its source and the one found in an earlier version of it."""
    return (
        F.when(stored.isNull(), "nothing_stored").when(found.isNull(), "not_found").when(partial_equal(stored, found), "pass").when(noted_only, "noted")
        .when(earlier.isNull(), "inconclusive").when(partial_equal(stored, earlier), "stored_confirmed").when(partial_equal(found, earlier), "corrected").otherwise("third_date")
    )
