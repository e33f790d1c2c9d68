"""Authored configuration in TOML. Each reader lists every problem before it refuses a file."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass
from datetime import date
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.rules import Rule, When


class ConfigurationError(ValueError):
    """All problems of a file."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = problems


def _table(text: str, name: str) -> dict[str, Any]:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ConfigurationError([f"{name}: {error}"]) from None


def _fields(where: str, got: dict[str, Any], need: dict[str, type], may: dict[str, type], problems: list[str]) -> None:
    for k in sorted(need.keys() - got.keys()):
        problems.append(f"{where}: {k} is missing")
    for k, v in got.items():
        kind = need.get(k) or may.get(k)
        if kind is None:
            problems.append(f"{where}: {k} is unknown")
        elif not isinstance(v, kind) or (kind is int and isinstance(v, bool)):
            problems.append(f"{where}: {k} is not a {kind.__name__}")


@dataclass(frozen=True)
class Taxonomy:
    groups: dict[str, tuple[str, str]]
    categories: dict[str, tuple[str, str]]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, name, g, self.groups[g][0], self.groups[g][1]) for c, (name, g) in sorted(self.categories.items())]
        return spark.createDataFrame(rows, "category_id string, name string, group_id string, group_name string, direction string")


def read_taxonomy(text: str) -> Taxonomy:
    data, problems = _table(text, "taxonomy"), []
    for k, g in data.get("group", {}).items():
        _fields(f"group {k}", g, {"name": str, "direction": str}, {}, problems)
        if g.get("direction") not in (None, "income", "expense"):
            problems.append(f"group {k}: direction is income or expense")
    problems += [f"category {k}: the id is reserved" for k in data.get("category", {}) if k in ("transfer", "adjustment", "unknown")]
    for k, c in data.get("category", {}).items():
        _fields(f"category {k}", c, {"name": str, "group": str}, {}, problems)
        if isinstance(c.get("group"), str) and c["group"] not in data.get("group", {}):
            problems.append(f"category {k}: no group {c['group']}")
    if problems:
        raise ConfigurationError(problems)
    return Taxonomy({k: (g["name"], g["direction"]) for k, g in data.get("group", {}).items()}, {k: (c["name"], c["group"]) for k, c in data.get("category", {}).items()})


ACCOUNT = "account_id string, display_name string, account_type string, owner_id string, currency string, source_format string, bank_account_number string, closed_on date"


def read_accounts(text: str, formats: set[str]) -> tuple[list[tuple], list[tuple[str, str, int]]]:
    """Rows for ``ACCOUNT``, and owners as ``id, name, display order``."""
    data, problems, numbers, rows = _table(text, "accounts"), [], {}, []
    owners = data.get("owners", {})
    for k, a in data.get("account", {}).items():
        _fields(f"account {k}", a, {"display_name": str, "account_type": str, "owner": str, "currency": str, "source_format": str}, {"bank_account_number": str, "closed_on": date}, problems)
        for key, good in (("account_type", {"current", "savings"}), ("owner", set(owners)), ("currency", {"DKK"}), ("source_format", formats)):
            if isinstance(a.get(key), str) and a[key] not in good:
                problems.append(f"account {k}: {key} {a[key]} is not one of {', '.join(sorted(good))}")
        number = a.get("bank_account_number")
        if number in numbers:
            problems.append(f"account {k}: {number} is account {numbers[number]}'s")
        elif number:
            numbers[number] = k
        rows.append((k, a.get("display_name"), a.get("account_type"), a.get("owner"), a.get("currency"), a.get("source_format"), number, a.get("closed_on")))
    if problems:
        raise ConfigurationError(problems)
    return rows, [(k, v, n) for n, (k, v) in enumerate(owners.items(), 1)]


_WHEN = {"account": str, "description_contains": object, "description_starts_with": object, "description_regex": object, "amount_sign": str, "amount_min": object, "amount_max": object, "date_from": date, "date_to": date, "bank_category": str, "bank_subcategory": str}


def _texts(v: Any) -> tuple[str, ...]:
    return (v,) if isinstance(v, str) else tuple(v or ())


def read_rules(text: str, taxonomy: Taxonomy) -> list[Rule]:
    data, problems, out, seen = _table(text, "rules"), [], [], set()
    for n, r in enumerate(data.get("rule", []), 1):
        where = f"rule {r.get('id', n)}"
        _fields(where, r, {"id": str, "when": dict, "then": dict}, {"priority": int}, problems)
        when, then = r.get("when", {}), r.get("then", {})
        _fields(f"{where}: when", when, {}, _WHEN, problems)
        _fields(f"{where}: then", then, {}, {"category": str, "transfer_claim": bool, "adjustment": str}, problems)
        if r.get("id") in seen:
            problems.append(f"{where}: the id is used before")
        seen.add(r.get("id"))
        for key in ("description_contains", "description_starts_with", "description_regex"):
            texts = when.get(key, "x")
            texts = [texts] if isinstance(texts, str) else texts
            if not isinstance(texts, list) or not texts or not all(isinstance(x, str) and x.strip() for x in texts):
                problems.append(f"{where}: {key} is a text, or a list of texts, that isn't blank")
                when = {k: v for k, v in when.items() if k != key}
        if not r.get("when"):
            problems.append(f"{where}: when is empty")
        if then.get("transfer_claim", True) is not True:
            problems.append(f"{where}: transfer_claim is true or left out")
        if isinstance(then.get("adjustment"), str) and not then["adjustment"].strip():
            problems.append(f"{where}: adjustment is a reason")
        if len(then) != 1:
            problems.append(f"{where}: then has one outcome")
        if then.get("category") is not None and then["category"] not in taxonomy.categories:
            problems.append(f"{where}: no category {then['category']}")
        if when.get("amount_sign") not in (None, "positive", "negative"):
            problems.append(f"{where}: amount_sign is positive or negative")
        for p in _texts(when.get("description_regex")):
            try:
                re.compile(p)
            except re.error as error:
                problems.append(f"{where}: {p}: {error}")
        money = {}
        for key in ("amount_min", "amount_max"):
            if key in when:
                try:
                    money[key] = Decimal(str(when[key]))
                except InvalidOperation:
                    problems.append(f"{where}: {key} is not an amount")
        if problems:
            continue
        out.append(
            Rule(
                r["id"],
                When(when.get("account"), _texts(when.get("description_contains")), _texts(when.get("description_starts_with")), _texts(when.get("description_regex")), when.get("amount_sign"), money.get("amount_min"), money.get("amount_max"), when.get("date_from"), when.get("date_to"), when.get("bank_category"), when.get("bank_subcategory")),
                r.get("priority", 0),
                then.get("category"),
                then.get("adjustment"),
                bool(then.get("transfer_claim")),
            )
        )
    if problems:
        raise ConfigurationError(problems)
    return out


def read_ranges(text: str, accounts: set[str]) -> dict[str, tuple[date, date]]:
    """Each account's declared range: its own, or the default."""
    data, problems = _table(text, "ranges"), []
    if data.get("format") != 1:
        problems.append("format is 1")
    default = data.get("default", {})
    out = {}
    for k in sorted(accounts | data.get("account", {}).keys()):
        if k not in accounts:
            problems.append(f"account {k} is not declared")
            continue
        own = {**default, **data.get("account", {}).get(k, {})}
        a, z = own.get("from"), own.get("through")
        if not isinstance(a, date) or not isinstance(z, date):
            problems.append(f"account {k}: from and through are dates")
        elif a > z:
            problems.append(f"account {k}: from is after through")
        else:
            out[k] = (a, z)
    if problems:
        raise ConfigurationError(problems)
    return out


@dataclass(frozen=True)
class Profile:
    """Where an installation keeps its data, and its settings."""

    root: str
    inbox: str
    late_booking_days: int = 7
    keep_all_days: int = 14
    keep_daily_days: int = 365


def read_profile(text: str) -> Profile:
    data, problems = _table(text, "profile"), []
    days = {"late_booking_days": (0, 366), "keep_all_days": (0, 3660), "keep_daily_days": (0, 36600)}
    _fields("profile", data, {"root": str, "inbox": str}, dict.fromkeys(days, int), problems)
    for k, (least, most) in days.items():
        v = data.get(k)
        if isinstance(v, int) and not isinstance(v, bool) and not least <= v <= most:
            problems.append(f"profile: {k} is from {least} to {most}")
    if problems:
        raise ConfigurationError(problems)
    return Profile(**data)


def check(texts: dict[str, str], formats: set[str], log: bytes = b"") -> list[str]:
    """Every problem of all files and the decision log, each named by its file: ``accounts, taxonomy, rules, ranges, profile``."""
    from .decision_log import read_log

    found: list[str] = []

    def tried(name: str, read):
        if name not in texts:
            return None
        try:
            return read(texts[name])
        except ConfigurationError as error:
            found.extend(f"{name}: {x}" for x in error.problems)
            return None

    tried("profile", read_profile)
    accounts = tried("accounts", lambda t: read_accounts(t, formats))
    taxonomy = tried("taxonomy", read_taxonomy)
    if taxonomy is not None:
        tried("rules", lambda t: read_rules(t, taxonomy))
    if accounts is not None:
        tried("ranges", lambda t: read_ranges(t, {r[0] for r in accounts[0]}))
    return found + [f"decisions: {x}" for x in read_log(log).problems]
