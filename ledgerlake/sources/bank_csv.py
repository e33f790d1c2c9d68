"""Bank exports: strict CSV in windows-1252, every field quoted, read whole or not at all.

Spark's own CSV reader is neither strict about quotes nor knows the character
set, so payloads are read as binary files and parsed in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.silver import HEADER, LABELS

HEADERS = ((HEADER[0], *LABELS, *HEADER[1:]), HEADER)
DELIMITERS = (",", ";")
DAY = re.compile(r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}")
#: Records, the first and last date in them, and the fault for which a payload is refused (null: none).
Parsed = tuple[list[dict[str, str]], tuple[date, date] | None, str | None]


@lru_cache(maxsize=4)
def _grammar(delimiter: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """A field, an escaped quote in it, and what ends it.

    A quote in a field is doubled, or has a backslash before it; but a backslash and a
    quote before a delimiter, a line break or the end are a backslash and the field's end.
    """
    escaped = rf'\\"(?![{delimiter}\r\n]|\Z)'
    return re.compile(rf'"((?:[^"\\]|{escaped}|""|\\)*+)"'), re.compile(rf'{escaped}|""'), re.compile(rf"{delimiter}|\r\n|\r|\n|\Z")


def parse_danske(content: bytes) -> Parsed:
    """Records as field maps, or the first fault of the payload."""
    try:
        text = content.decode("cp1252")
    except UnicodeDecodeError:
        return [], None, "not windows-1252"
    head = re.compile(r'"(?:[^"]|"")*"([,;])').match(text)
    delimiter = head[1] if head else DELIMITERS[0]
    field, quote, ends = _grammar(delimiter)
    lines, record, at = [], [], 0
    while at < len(text):
        m = field.match(text, at)
        if not m:
            return [], None, f"record {len(lines) + 1}: a field is not quoted or doesn't end"
        end = ends.match(text, m.end())
        if not end:
            return [], None, f"record {len(lines) + 1}: text after a field's end"
        record.append(quote.sub('"', m[1] + '"')[:-1])
        at = end.end()
        if end[0] != delimiter:
            lines.append(record)
            record = []
    if record:
        return [], None, "the last record ends with a delimiter"
    if not lines or tuple(lines[0]) not in HEADERS:
        return [], None, "unknown header"
    records, days = [], []
    for k, r in enumerate(lines[1:], 1):
        if len(r) != len(lines[0]):
            return [], None, f"record {k}: {len(r)} fields for {len(lines[0])}"
        records.append(dict(zip(lines[0], r, strict=True)))
    for k, r in enumerate(records, 1):
        try:
            if not DAY.fullmatch(r["Dato"]):
                raise ValueError
            days.append(date(*map(int, reversed(r["Dato"].split(".")))))
        except ValueError:
            return [], None, f"record {k}: unreadable date"
    return records, (min(days), max(days)) if days else None, None


def parse_ledger(content: bytes) -> Parsed:
    """The second format: tab-separated UTF-8 with ``when, sum, memo, bal, state``."""
    lines = content.decode("utf-8", "replace").splitlines()
    if not lines or lines[0].split("\t") != ["when", "sum", "memo", "bal", "state"]:
        return [], None, "unknown header"
    state = {"booked": "Udført", "pending": "Venter"}
    out, days = [], []
    for k, line in enumerate(lines[1:], 1):
        f = line.split("\t")
        if len(f) != 5:
            return [], None, f"record {k}: {len(f)} fields for 5"
        try:
            days.append(date.fromisoformat(f[0]))
        except ValueError:
            return [], None, f"record {k}: unreadable date"
        out.append({"Dato": days[-1].strftime("%d.%m.%Y"), "Tekst": f[2], "Beløb": f[1].replace(".", ","), "Saldo": f[3].replace(".", ","), "Status": state.get(f[4], f[4]), "Afstemt": ""})
    return out, (min(days), max(days)) if days else None, None


#: Parsers by declared format; more can be registered.
PARSERS: dict[str, Callable[[bytes], Parsed]] = {"danske-csv-v1": parse_danske, "synthetic-ledger-v1": parse_ledger}


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """``<inbox>/<account_id>/<file>``: content, its hash, and what the file's name says. Files that lie elsewhere have no account."""
    rows = described(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), path)
    return rows.orderBy("declared_account_id", "original_filename")


def described(rows: DataFrame, inbox: str | None = None) -> DataFrame:
    """``path, content`` with ``payload_id, declared_account_id, original_filename, exported_on, account_number``.

    With ``inbox`` an account is only read from a path of exactly one folder below it.
    """
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    account = F.element_at(parts, -2)
    if inbox is not None:
        below = F.substring_index("path", inbox.rstrip("/").split("/")[-1] + "/", -1)
        account = F.when(F.size(F.split(below, "/")) == 2, account)
    day = F.nullif(F.regexp_extract(name, r"(?i)-(\d{8})(?: ?\(\d+\))?\.csv$", 1), F.lit(""))
    number = F.nullif(F.regexp_extract(name, r"(?i).-(\d{10})-\d{8}(?: ?\(\d+\))?\.csv$", 1), F.lit(""))
    return rows.select(
        F.sha2("content", 256).alias("payload_id"),
        account.alias("declared_account_id"),
        name.alias("original_filename"),
        F.try_to_date(day, "yyyyMMdd").alias("exported_on"),
        number.alias("account_number"),
        F.octet_length("content").alias("byte_length"),
        "content",
    )


def misfiled(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """``declared_account_id, original_filename, problem`` of files whose name has no export date, or another account's number, or that lie in no account's folder."""
    numbers = accounts.select(F.col("account_id").alias("declared_account_id"), "bank_account_number")
    rows = files.join(numbers, "declared_account_id", "left")
    problem = (
        F.when(F.col("declared_account_id").isNull(), "not-in-an-account-folder")
        .when(F.col("exported_on").isNull(), "no-export-date")
        .when(F.col("account_number") != F.col("bank_account_number"), "another-account-number")
    )
    return rows.select("declared_account_id", "original_filename", problem.alias("problem")).where("problem is not null")


PARSED = "payload_id string, source_format string, record_ordinal int, fields map<string,string>, first_date date, last_date date, reason string"


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """``payloads(payload_id, source_format, content)`` as records, or one row with the reason why there are none.

    ``first_date`` and ``last_date`` span all records of a payload.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, fmt, content in zip(b["payload_id"], b["source_format"], b["content"], strict=True):
                parser = PARSERS.get(fmt)
                records, span, reason = parser(bytes(content)) if parser else ([], None, f"unknown format {fmt}")
                first, last = span or (None, None)
                out += [(p, fmt, k, r, first, last, None) for k, r in enumerate(records, 1)] if reason is None else [(p, fmt, None, None, None, None, reason)]
            frame = pd.DataFrame(out, columns=["payload_id", "source_format", "record_ordinal", "fields", "first_date", "last_date", "reason"])
            frame["record_ordinal"] = frame["record_ordinal"].astype("Int32")
            yield frame

    return payloads.select("payload_id", "source_format", "content").mapInPandas(run, PARSED)
