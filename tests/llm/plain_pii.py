"""A plain version of the terms that give an entity away, with whole sets of texts."""

import math
import re
from collections import defaultdict

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def names(text):
    """Entities and their groups."""
    out = set()
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email":
                out |= {(kind, m[0].lower()), ("domain", m[0].lower().rpartition("@")[2])}
            elif kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")):
                out |= {(kind, m[0]), ("network", m[0].rpartition(".")[0])}
            elif kind == "card" and 14 <= len(digits) <= 19 and luhn(digits):
                out |= {(kind, m[0]), ("issuer", digits[:6])}
            elif kind == "phone" and 10 <= len(digits) <= 15:
                out |= {(kind, m[0]), ("area", "+" + digits[:5])}
    return out


def revealing(texts, support=2, disclosure=0.8, removal=0.95, z=1.64):
    """Per document, the words (as written) that are generalised or removed."""
    distinct = {t for t in texts.values() if t is not None}
    words = {t: {w for w in re.findall(r"[^\W_]+", t.lower()) if len(w) >= 3 and re.search(r"[^\W\d_]", w)} for t in distinct}
    holds, has = defaultdict(set), defaultdict(set)
    for t in distinct:
        for w in words[t]:
            has[w].add(t)
        for e in names(t):
            holds[e].add(t)
    told = defaultdict(dict)
    for inside in holds.values():
        bits = math.log2(len(distinct) / len(inside))
        if len(inside) < support or bits < 3:
            continue
        for w in set.union(*(words[t] for t in inside)):
            n, hits = len(has[w]), len(has[w] & inside)
            if hits >= support:
                p = hits / n
                low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                share = 1 + math.log2(low) / bits
                if share >= disclosure:
                    for t in inside & has[w]:
                        told[t][w] = max(share, told[t].get(w, 0))
    return {k: {(w, "gone" if told[t][w.lower()] >= removal else "term") for w in re.findall(r"[^\W_]+", t or "") if w.lower() in told[t]} if t is not None else set() for k, t in texts.items()}
