"""The decision log: JSON lines whose order matters, folded into the decisions in force."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: What each kind decides about a transaction; kinds of one group exclude each other (fixed values).
GROUPS = {"classify": "gold", "pair": "gold", "one-sided-transfer": "gold", "withdrawn": "silver", "same-transaction": "silver", "void-import-run": "run", "accept-discrepancy": "run", "retract": None}
FORCE = "decision_id string, kind string, targets array<string>, category string, adjustment string, counterpart_account_id string, reason string"


@dataclass
class Log:
    in_force: dict[str, dict[str, Any]] = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        keys = [x.split()[0] for x in FORCE.split(", ")]
        return spark.createDataFrame([tuple(e.get(k) for k in keys) for e in self.in_force.values()], FORCE)


#: Fields of an entry: the types that they may have.
TEXTS = ("decision_id", "kind", "category", "adjustment", "counterpart_account_id", "reason", "import_run_id")
#: What an entry of a kind must have, besides its targets: one of each group of fields (fixed values).
NEEDS = {"classify": [("category", "adjustment")], "one-sided-transfer": [("counterpart_account_id",)], "same-transaction": [("record",)], "withdrawn": [], "pair": [], "void-import-run": [], "accept-discrepancy": [], "retract": []}
TARGETS = {"pair": 2, "retract": None}


def _shape(entry: Any) -> str | None:
    """What keeps a line from being an entry at all."""
    if not isinstance(entry, dict):
        return "not a decision"
    for name in TEXTS:
        if entry.get(name) is not None and not isinstance(entry[name], str):
            return f"{name} is not a text"
    if entry.get("kind") not in GROUPS or entry.get("decision_id") is None:
        return "not a decision"
    for name in ("targets", "supersedes"):
        listed = entry.get(name, [])
        if not isinstance(listed, list) or not all(isinstance(x, str) for x in listed):
            return f"{name} is not a list of texts"
    record = entry.get("record")
    if record is not None and not (isinstance(record, dict) and isinstance(record.get("payload_id"), str) and type(record.get("record_ordinal")) is int):
        return "record doesn't name a payload and a record"
    return None


def _incomplete(entry: dict[str, Any]) -> list[str]:
    kind, found = entry["kind"], []
    wanted = TARGETS.get(kind, 1)
    if wanted is not None and len(entry["targets"]) != wanted:
        found.append(f"{kind} names {wanted} targets, not {len(entry['targets'])}")
    for names in NEEDS[kind]:
        given = sum(entry.get(n) is not None for n in names)
        if given != 1:
            found.append(f"{kind} has one of {' and '.join(names)}, not {given}")
    return found


class _Claims:
    """Who decides what: by group and target, the entries in force with the payload that each is for (None: for all)."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, str], dict[str, str | None]] = {}

    @staticmethod
    def of(entry: dict[str, Any]) -> tuple[list[tuple[str, str]], str | None]:
        group = GROUPS[entry["kind"]]
        return ([(group, t) for t in dict.fromkeys(entry["targets"])] if group else []), (entry.get("record") or {}).get("payload_id")

    def rivals(self, entry: dict[str, Any]) -> dict[str, list[str]]:
        """Entries in force that decide a target of this one, with these targets."""
        found: dict[str, list[str]] = {}
        keys, payload = self.of(entry)
        for key in keys:
            for other, theirs in self.held.get(key, {}).items():
                if payload is None or theirs is None or payload == theirs:
                    found.setdefault(other, []).append(key[1])
        return found

    def take(self, entry: dict[str, Any]) -> None:
        keys, payload = self.of(entry)
        for key in keys:
            self.held.setdefault(key, {})[entry["decision_id"]] = payload

    def drop(self, entry: dict[str, Any]) -> None:
        for key in self.of(entry)[0]:
            self.held[key].pop(entry["decision_id"], None)


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    keys = [k for k, _ in pairs]
    if len(set(keys)) < len(keys):
        raise KeyError(next(k for k in keys if keys.count(k) > 1))
    return dict(pairs)


def read_log(content: bytes) -> Log:
    """Fold the lines in order; an entry with a problem never comes into force. A last line without its end was cut off and is left out."""
    text = content.decode("utf-8-sig")
    lines = text.split("\n")
    log, used, claims = Log(), set(), _Claims()
    if lines and lines[-1]:
        log.problems.append(f"entry {len(lines)}: cut off")
    for n, line in enumerate(lines[:-1], 1):
        try:
            e = json.loads(line, object_pairs_hook=_unique)
        except KeyError as error:
            log.problems.append(f"entry {n}: {error.args[0]} is there twice")
            continue
        except (json.JSONDecodeError, RecursionError):
            e = None
        odd = _shape(e)
        if odd is not None:
            log.problems.append(f"entry {n}: {odd}")
            continue
        e["targets"], over = e.get("targets", []), e.get("supersedes", [])
        found = _incomplete(e)
        if e["decision_id"] in used:
            found.append(f"the name {e['decision_id']} is taken")
        rivals = claims.rivals(e)
        for s in over:
            if s not in log.in_force:
                found.append(f"takes the place of {s}, which holds no longer or never did")
            elif e["kind"] != "retract" and s not in rivals:
                found.append(f"takes the place of {s}, which is about something else")
        found += [f"{t} is already settled, by {other}" for other, ts in rivals.items() if other not in over for t in sorted(ts)]
        if found:
            log.problems += [f"entry {n}: {x}" for x in found]
            continue
        used.add(e["decision_id"])
        for s in dict.fromkeys(over):
            claims.drop(log.in_force.pop(s))
        if e["kind"] != "retract":
            log.in_force[e["decision_id"]] = e
            claims.take(e)
    return log


def prefix_hashes(content: bytes) -> list[str]:
    """The hash of the log's first n complete lines, for each n from 0 on: what a publication records of the log that it saw."""
    h, out = hashlib.sha256(), [hashlib.sha256().hexdigest()]
    for line in content.split(b"\n")[:-1]:
        h.update(line + b"\n")
        out.append(h.copy().hexdigest())
    return out


def rewritten(content: bytes, recorded: dict[int, tuple[int, str]]) -> list[int]:
    """Publications whose recorded ``(entries, hash)`` isn't a prefix of the log any more."""
    now = prefix_hashes(content)
    return sorted(k for k, (n, h) in recorded.items() if n >= len(now) or now[n] != h)


def append(path: str, entries: list[dict[str, Any]]) -> None:
    """Append entries to the log and force them to disk."""
    import os

    with open(path, "ab") as f:
        f.write("".join(json.dumps(e, ensure_ascii=False) + "\n" for e in entries).encode())
        f.flush()
        os.fsync(f.fileno())
