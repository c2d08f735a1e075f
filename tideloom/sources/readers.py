"""Sources beyond plain tables: packed lines, key/value blocks, bibliographies, mailboxes, SQL dumps, feeds, nested documents."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.functions.text import last_wins
from tideloom.operators.reshape import unpack_counts


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Long form of packed count lines."""
    return unpack_counts(spark.read.text(path), "value")


def read_csv(spark: SparkSession, path: str | list[str], schema: str, provenance: bool = False) -> DataFrame:
    """CSV with header and an explicit schema; several files by a glob or list. A value that doesn't fit its type is null."""
    df = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", multiLine=True, escape='"')
    return df.withColumn("source_file", F.col("_metadata.file_path")) if provenance else df


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested JSON documents, one a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_blocks(spark: SparkSession, path: str, key: str = "citekey", newline: str = "\n") -> DataFrame:
    """Blocks of `name: value` lines between lines of `---` as maps; blocks without the key are notes and are skipped. Dashes inside
    a line cut nothing."""
    blocks = spark.read.option("lineSep", f"{newline}---{newline}").text(path)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"^\s*[A-Za-z_]+\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^\s*([A-Za-z_]+)\s*:", 1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    return blocks.select(last_wins(pairs).alias("fields")).where(F.coalesce(F.try_element_at("fields", F.lit(key)), F.lit("")) != "")


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """(kind, citekey, fields map) of bibliography entries; values in braces or quotes, a byte-order mark is dropped, of a field given
    twice the last holds."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    entry = whole.select(F.explode(F.split("value", r"(?m)^(?=\s*@\w+\s*\{)")).alias("e")).where(F.col("e").rlike(r"^\s*@\w+\s*\{"))
    found = F.regexp_extract_all("e", F.lit(r'(?s)(\w+)\s*=\s*(\{(?:[^{}]|\{[^{}]*\})*\}|"[^"]*"|\d+)'), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^(\w+)", 1)).alias("k"), F.regexp_replace(F.regexp_replace(x, r'(?s)^\w+\s*=\s*[{"]?', ""), r'(?s)[}"]?$', "").alias("v")))
    return entry.select(F.lower(F.regexp_extract("e", r"@(\w+)", 1)).alias("kind"), F.trim(F.regexp_extract("e", r"@\w+\s*\{\s*([^,\s]+)", 1)).alias("citekey"), last_wins(pairs).alias("fields"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Paths only: the content column is pruned, so nothing is read here."""
    return spark.read.format("binaryFile").load(path).select("path")


def _lines(path: str) -> Iterator[bytes]:
    """Lines of a file, compressed or not, in chunks of bounded size."""
    fs, p = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    rest = b""
    with fs.open_input_stream(p, compression="detect") as f:
        while chunk := f.read(1 << 22):
            *whole, rest = (rest + chunk).split(b"\n")
            yield from (x + b"\n" for x in whole)
    if rest:
        yield rest


MESSAGE = "path string, no int, sender string, subject string, sent string, body string"


def _message(raw: bytes) -> tuple[str | None, str | None, str | None, str]:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    texts = []
    for part in m.walk():
        if part.get_content_type() == "text/plain":
            try:
                texts.append(part.get_content())
            except (LookupError, UnicodeError):
                texts.append((part.get_payload(decode=True) or b"").decode("latin-1"))
    return str(m["From"] or "") or None, str(m["Subject"] or "") or None, str(m["Date"] or "") or None, "\n".join(texts)


def read_mailbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mbox files, plain or gzip: decoded headers and the plain-text parts. Framing is sequential, so one task passes a
    file, line by line; it holds one message at a time."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "no", "sender", "subject", "sent", "body"]
        for b in batches:
            for p in b["path"]:
                no, raw, out = 0, [], []
                for line in chain(_lines(p), [b"From "]):
                    if not line.startswith(b"From "):
                        raw.append(line)
                        continue
                    if b"".join(raw).strip():
                        no += 1
                        out.append((p, no, *_message(b"".join(raw))))
                    raw = []
                    if len(out) >= 500:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                yield pd.DataFrame(out, columns=columns)

    return _files(spark, path).mapInPandas(parse, MESSAGE)


def _tuples(text: str) -> Iterator[list[str | None]]:
    """Value lists of one INSERT statement."""
    token = re.compile(r"'((?:[^'\\]|\\.|'')*)'|([^\s,()']+)|([(),])")
    row: list[str | None] | None = None
    for m in token.finditer(text):
        if m[3] == "(":
            row = []
        elif m[3] == ")":
            if row is not None:
                yield row
            row = None
        elif m[3] is None and row is not None:
            if m[1] is not None:
                row.append(re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "0": "\0"}.get(x[1], x[1]), m[1].replace("''", "'")))
            else:
                row.append(None if m[2].upper() == "NULL" else m[2])


def _statements(lines: Iterator[bytes]) -> Iterator[str]:
    """SQL statements: they end with a semicolon at the end of a line outside of quotes."""
    parts: list[str] = []
    quoted = False
    for line in lines:
        text = line.decode("utf-8", "replace")
        if not parts and re.match(r"\s*(--|/\*|#|$)", text):
            continue
        parts.append(text)
        for m in re.finditer(r"\\.|''|'", text):
            quoted ^= m[0] == "'"
        if not quoted and text.rstrip().endswith(";"):
            yield "".join(parts)
            parts = []
    if parts:
        yield "".join(parts)


def read_sql_dump(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """Rows a SQL dump inserts into one table, as strings. One task passes a file, plain or gzip, and holds one statement at a time.

    If a statement names its columns, values follow the names; else their position. Rows with fewer values are filled with nulls,
    surplus values are left out.
    """
    head = re.compile(rf"\s*INSERT\s+INTO\s+[`\"]?{re.escape(name)}[`\"]?\s*(?:\(([^)]*)\))?\s*VALUES", re.I)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                for statement in _statements(_lines(p)):
                    if m := head.match(statement):
                        names = [x.strip(' `"') for x in m[1].split(",")] if m[1] else columns
                        rows = [dict(zip(names, r)) for r in _tuples(statement[m.end() :])]
                        yield pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns, dtype=object)

    return _files(spark, path).mapInPandas(parse, ", ".join(f"`{c}` string" for c in columns))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds."""
    schema = "title string, summary string, published string, author array<struct<name:string>>, link array<struct<_href:string>>"
    return spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)


def read_header_rows(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of arrays whose first row is the header, as one map a row. A short row lacks the last names, a long one loses the rest."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("a"))
    both = rows.select(F.explode(F.slice("a", 2, 1 << 30)).alias("r"), F.col("a")[0].alias("h"))
    pairs = F.zip_with(F.slice("h", F.lit(1), F.least(F.size("h"), F.size("r"))), F.slice("r", F.lit(1), F.least(F.size("h"), F.size("r"))), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    return both.select(last_wins(F.filter(pairs, lambda x: x.k.isNotNull())).alias("fields"))


def read_database(spark: SparkSession, url: str, table: str, column: str, bounds: tuple[int, int], partitions: int, **options: str) -> DataFrame:
    """A remote table in parallel ranges of a numeric column. The driver's jar must be on the class path."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", column)
    return r.option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions).options(**options).load()
