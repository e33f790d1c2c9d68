"""What bank labels suggest: the rules that cover them, and drafts of a taxonomy and rules."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fold
from .finding import label_directions, label_pairs
from .rules import Rule, When

#: How Danish spells its letters out, and ids that no category may have (fixed values).
SPELLED = {"æ": "ae", "ø": "oe", "å": "aa"}
RESERVED = {"transfer", "adjustment", "unknown"}


def label_rules(made: Sequence[Rule]) -> list[Rule]:
    """Rules that look at nothing but the bank's labels."""
    return [r for r in made if r.when.bank_category is not None and replace(r.when, bank_category=None, bank_subcategory=None) == When()]


def covered(pairs: DataFrame, made: Sequence[Rule]) -> DataFrame:
    """``pairs(category, subcategory)`` with ``covered_by``: the sorted ids of label rules that match; a rule without a subcategory matches any.

    Rules are few: each is one condition of one projection.
    """
    category, sub = fold(F.col("category")), fold(F.col("subcategory"))
    hits = []
    for r in label_rules(made):
        match = category == r.when.bank_category.casefold()
        if r.when.bank_subcategory is not None:
            match = match & F.coalesce(sub == r.when.bank_subcategory.casefold(), F.lit(False))
        hits.append(F.when(match, F.lit(r.rule_id)))
    found = F.array_sort(F.array_compact(F.array(*hits))) if hits else F.array().cast("array<string>")
    return pairs.withColumn("covered_by", found)


def slug(text: str) -> str:
    """An id in ASCII: lower case, Danish letters spelled out, accents dropped, words joined by hyphens."""
    plain = "".join(SPELLED.get(c, c) for c in text.lower())
    plain = unicodedata.normalize("NFKD", plain).encode("ascii", "ignore").decode()
    return "-".join("".join(c if c.isalnum() else " " for c in plain).split()) or "x"


def unique_ids(wanted: Iterable[str], taken: Iterable[str] = ()) -> list[str]:
    """Each wanted id, or the first of ``-2``, ``-3``, ... that isn't taken or reserved."""
    used, out = set(taken) | RESERVED, []
    for name in wanted:
        found, n = name, 2
        while found in used:
            found, n = f"{name}-{n}", n + 1
        used.add(found)
        out.append(found)
    return out


def drafts(rows: DataFrame, made: Sequence[Rule] = ()) -> tuple[str, str]:
    """A taxonomy and rules in TOML for label pairs that no rule covers; ``rows``: ``category, subcategory, amount``, and ``currency`` if there are several.

    A bank's labels are few, so they are gathered here.
    """
    rows = rows if "currency" in rows.columns else rows.withColumn("currency", F.lit(None).cast("string"))
    pairs = covered(label_pairs(rows), made).where(F.size("covered_by") == 0)
    direction = {r["category"]: r["direction"] for r in label_directions(pairs).collect()}
    sums = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.col("total").cast("string"), "currency"))), " and ").alias("total")
    listed = pairs.groupBy("category", "subcategory").agg(F.sum("n_rows").alias("n_rows"), sums).orderBy("category", F.asc_nulls_last("subcategory")).collect()
    text = lambda x: json.dumps(x, ensure_ascii=False).replace("\x7f", "\\u007f")
    groups = sorted({r["category"] for r in listed})
    group_id = dict(zip(groups, unique_ids(map(slug, groups)), strict=True))
    names = unique_ids([slug(r["subcategory"] or r["category"]) for r in listed])
    taxonomy = [f"[group.{group_id[g]}]\nname = {text(g)}\ndirection = {text(direction[g])}\n" for g in groups]
    rules = []
    for r, name in zip(listed, names, strict=True):
        taxonomy.append(f"# {r['n_rows']} transactions, {r['total']}\n[category.{name}]\nname = {text(r['subcategory'] or r['category'])}\ngroup = {text(group_id[r['category']])}\n")
        sub = f", bank_subcategory = {text(r['subcategory'])}" if r["subcategory"] is not None else ""
        rules.append(f"[[rule]]\nid = {text('label-' + name)}\nwhen = {{ bank_category = {text(r['category'])}{sub} }}\nthen = {{ category = {text(name)} }}\n")
    return "\n".join(taxonomy), "\n".join(rules)
