"""Text helpers: Unicode normal form, title rules."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfc(c: Column) -> Column:
    """Composed normal form. Spark has no such function; only values beyond ASCII travel to Python."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def nfkc(c: Column) -> Column:
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def last_wins(pairs: Column) -> Column:
    """A map of an array of structs (k, v); of a name given twice the last holds."""
    empty = F.expr("cast(map() as map<string,string>)")
    return F.aggregate(pairs, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p.k), F.create_map(p.k, p.v)))


def normal_form(c: Column) -> Column:
    """Compatibility form in lower case, white space single, soft hyphens and zero-width characters gone."""
    t = F.regexp_replace(F.lower(nfkc(c)), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(t, "[\u00ad\u200b\u200c\u200d\ufeff]", ""))


def hard_form(c: Column) -> Column:
    """normal_form with quotes and dashes of one kind, hyphenation undone, and nothing but letters a to z, digits and single blanks."""
    t = F.translate(normal_form(c), "‘’“”–—", "''\"\"--")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"-\s+", ""), "[^a-z0-9 ]", " "), " +", " "))


def portable_ddl(c: Column) -> Column:
    """A table definition of a dump in plain SQL: no back-ticks, key lines, table options, collations or sizes of numbers."""
    t = F.replace(c, F.lit("`"), F.lit('"'))
    t = F.regexp_replace(t, r"(?im)^\s*(?:UNIQUE |FULLTEXT |SPATIAL )?(?:KEY|INDEX)\b.*$\n?", "")
    t = F.regexp_replace(t, r"(?i)\s+(?:COLLATE|CHARACTER SET)\s*=?\s*\w+|\s+COMMENT\s+'(?:[^']|'')*'|\s+UNSIGNED\b|\s+AUTO_INCREMENT\b(?!\s*=)", "")
    t = F.regexp_replace(t, r"(?i)\b(?:tiny|small|medium|big)?int\(\d+\)", "BIGINT")
    t = F.regexp_replace(t, r"(?i)\b(?:var)?(?:char|binary)\(\d+\)|\b(?:tiny|medium|long)?(?:text|blob)\b", "VARCHAR")
    t = F.regexp_replace(t, r",(\s*\))", "$1")
    return F.regexp_replace(t, r"(?is)\)\s*ENGINE\b[^;]*", ")")


def page_title(c: Column) -> Column:
    """Title rules: drop the fragment, outer blanks and a leading colon, blanks to underscores, first letter upper-case."""
    t = nfc(c)
    t = F.regexp_replace(t, r"(?s)#.*$", "")
    t = F.regexp_replace(t, r"^[\s_ ]+|[\s_ ]+$", "")
    t = F.regexp_replace(t, r"^:[\s_ ]*", "")
    t = F.replace(t, F.lit(" "), F.lit("_"))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2147483647))
