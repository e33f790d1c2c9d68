"""Many rules as data: an index from keys of a row to the rules that it may meet, whose conditions are then tested.

Each rule stands in a table of slots under one key that a row must have to meet it: a
text's first letters, three letters of a text that it contains or of a pattern, a bank
label or an account. The table and the rules' conditions are two constants of the plan, so that
rows are neither joined nor shuffled, and the plan is of one size for any number of rules.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Sequence
from decimal import Decimal
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import fold

if TYPE_CHECKING:
    from .rules import Rule, When

#: Letters of a key: of a text within, and of a beginning.
GRAM, BEGINNING = 3, 12
LIMIT = "decimal(38,6)"
CONDITIONS = f"""array<struct<priority:int,rule_id:string,outcome:string,account:string,contains:array<string>,starts:array<string>,regex:array<string>,
  positive:boolean,amount_min:{LIMIT},amount_max:{LIMIT},date_from:date,date_to:date,category:string,subcategory:string>>"""
LABELS = (("category", "bank_category"), ("subcategory", "bank_subcategory"))


def needed_text(pattern: str) -> str:
    """The longest run of letters that every match of a pattern has, folded; empty if that isn't plain to see.

    Patterns with groups, choices, classes or counts have none. Neither has a letter that
    other letters match without folding to it: only ASCII letters but i count, and digits and spaces.
    """
    if re.search(r"[|()\[\]{}]|\\[^bBdDsSwW]|\\$", pattern):
        return ""
    runs, run = [], ""
    for part in re.findall(r"\\.|.", pattern, re.DOTALL):
        if part in "*?":
            run = run[:-1]
        if re.fullmatch(r"[A-HJ-Za-hj-z0-9 ]", part):
            run += part.lower()
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)


def _grams(texts: Iterable[str]) -> list[list[str]]:
    return [["t:" + x[i : i + GRAM] for i in range(max(1, len(x) - GRAM + 1))] for x in texts]


def options(when: When) -> list[list[list[str]]]:
    """Ways to find a rule's rows: each has, for each of the texts of which one must be met, the keys of which any one will do."""
    out = []
    if when.starts_with and all(when.starts_with):
        out.append([["p:" + x.casefold()[:BEGINNING]] for x in when.starts_with])
    for texts in ([x.casefold() for x in when.contains], [needed_text(x) for x in when.regex]):
        if texts and all(texts):
            out.append(_grams(texts))
    labels = (("s", when.bank_subcategory), ("c", when.bank_category))
    out += [[[f"{kind}:{x.casefold()}"]] for kind, x in labels if x is not None]
    return out + ([[[f"a:{when.account}"]]] if when.account is not None else [])


def uses(rules: Iterable[Rule]) -> Counter:
    """How many rules could stand under each key."""
    return Counter(k for r in rules for k in {k for way in options(r.when) for ks in way for k in ks})


def keys(when: When, used: Counter) -> list[str] | None:
    """Keys of which a row that meets the rule has at least one, those that fewest other rules could stand under; None if there are none."""
    ways = [[min(ks, key=lambda k: (used[k], -len(k))) for ks in way] for way in options(when)]
    return min(ways, key=lambda way: sum(used[k] for k in way), default=None)


def _fits(limit: Decimal | None) -> bool:
    return limit is None or (abs(limit) < 10**32 and limit.as_tuple().exponent >= -6)


def split(rules: Iterable[Rule]) -> tuple[list[Rule], list[Rule]]:
    """Rules that the index holds, and those that need a condition of their own in the plan.

    The latter have a pattern and no key (a pattern that is a constant is compiled once), or
    a limit of more than six places.
    """
    held, plain = [], []
    for r in rules:
        own = (r.when.regex and not options(r.when)) or not (_fits(r.when.amount_min) and _fits(r.when.amount_max))
        (plain if own else held).append(r)
    return held, plain


def _row(r: Rule) -> dict:
    w, text = r.when, lambda x: None if x is None else str(x)
    low = lambda x: None if x is None else x.casefold()
    return {
        "priority": r.priority, "rule_id": r.rule_id, "outcome": r.outcome(), "account": text(w.account),
        "contains": [x.casefold() for x in w.contains] or None, "starts": [x.casefold() for x in w.starts_with] or None,
        "regex": ["(?iu)" + x.replace("(?P<", "(?<") for x in w.regex] or None,
        "positive": None if w.sign is None else w.sign == "positive",
        "amount_min": None if w.amount_min is None else f"{w.amount_min:f}", "amount_max": None if w.amount_max is None else f"{w.amount_max:f}",
        "date_from": text(w.date_from), "date_to": text(w.date_to), "category": low(w.bank_category), "subcategory": low(w.bank_subcategory),
    }


def _holds(r: Column, text: Column, used: set[str]) -> Column:
    """Whether the row meets the conditions ``r``; the dearest is last."""
    amount, day = F.col("amount"), F.col("transaction_date")
    tests = {
        "account": lambda x: F.col("account_id").cast("string") == x,
        "positive": lambda x: F.when(x, amount > 0).otherwise(amount < 0),
        "amount_min": lambda x: amount >= x,
        "amount_max": lambda x: amount <= x,
        "date_from": lambda x: day >= x,
        "date_to": lambda x: day <= x,
        **{name: lambda x, label=label: fold(F.col(label)) == x for name, label in LABELS},
        "starts": lambda x: F.exists(x, lambda y: F.startswith(text, y)),
        "contains": lambda x: F.exists(x, lambda y: F.contains(text, y)),
        "regex": lambda x: F.exists(x, lambda y: F.rlike(F.col("description"), y)),
    }
    all_of = [r[name].isNull() | test(r[name]) for name, test in tests.items() if name in used]
    return F.coalesce(reduce(lambda a, b: a & b, all_of, F.lit(True)), F.lit(False))


def _constant(x: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(x)), kind)


def _under(rules: Sequence[Rule], made: list[dict]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules, by number, under their keys; and those without a key."""
    counts = uses(rules)
    under: dict[str, list[int]] = {}
    everywhere = []
    for i, r in enumerate(rules):
        if all(made[i][name] is None for name in made[i] if name not in ("priority", "rule_id", "outcome")):
            continue
        found = keys(r.when, counts)
        if found is None:
            everywhere.append(i)
        for k in set(found or ()):
            under.setdefault(k, []).append(i)
    return under, everywhere


def _found(under: dict[str, list[int]], of_row: Column) -> Column:
    """Numbers of the rules that stand in the slots of a row's keys."""
    size = 1 << max(4, (4 * len(under)).bit_length())
    slots: list[list[int]] = [[] for _ in range(size)]
    for k, members in under.items():
        slots[zlib.crc32(k.encode()) % size] += members
    slot = lambda k: F.get(_constant(slots, "array<array<int>>"), (F.crc32(k) % size).cast("int"))
    return F.array_distinct(F.flatten(F.transform(of_row, slot)))


def under_text(rules: Sequence[Rule], text: Column) -> Column:
    """Numbers of the rules that stand under a key of ``text``, a folded description: what of a search depends on the text alone."""
    under, _ = _under(rules, [_row(r) for r in rules])
    under = {k: members for k, members in under.items() if k[0] in "pt"}
    own = [F.concat(F.lit("p:"), F.substring(text, 1, n)) for n in sorted({len(k) - 2 for k in under if k[0] == "p"})]
    of_row = [F.array(*own)] if own else []
    for n in sorted({len(k) - 2 for k in under if k[0] == "t"}):
        grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1))
        of_row.append(F.transform(F.array_distinct(F.coalesce(grams, F.array().cast("array<string>"))), lambda g: F.concat(F.lit("t:"), g)))
    return _found(under, F.array_compact(F.concat(*of_row))) if of_row else F.array().cast("array<int>")


def hits(rules: Sequence[Rule], text: Column, of_text: Column | None = None) -> Column:
    """The rules that a row meets, as structs of priority, rule_id and outcome; ``text`` is its folded description.

    Rules must be those that ``split`` gives as held. Rules without conditions match
    nothing. Those without a key (of sign, amounts or dates alone) are tested on every row.
    ``of_text``: what ``under_text`` gives, if it is known already (null: no text).
    """
    made = [_row(r) for r in rules]
    used = {name for row in made for name, x in row.items() if x is not None}
    under, everywhere = _under(rules, made)
    rest = {k: members for k, members in under.items() if k[0] not in "pt"}
    own = []
    if any(k[0] == "a" for k in rest):
        own.append(F.concat(F.lit("a:"), F.col("account_id").cast("string")))
    own += [F.concat(F.lit(f"{name[0]}:"), fold(F.col(label))) for name, label in LABELS if any(k[0] == name[0] for k in rest)]
    none = F.array().cast("array<int>")
    parts = [under_text(rules, text) if of_text is None else F.coalesce(of_text, none)]
    parts += [_found(rest, F.array_compact(F.array(*own)))] if own else []
    maybe = F.array_distinct(F.concat(*parts, _constant(everywhere, "array<int>")))
    meant = F.filter(F.transform(maybe, lambda i: F.get(_constant(made, CONDITIONS), i)), lambda r: _holds(r, text, used))
    return F.transform(meant, lambda r: F.struct(r["priority"].alias("priority"), r["rule_id"].alias("rule_id"), r["outcome"].alias("outcome")))
