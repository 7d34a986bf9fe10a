"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
UUID = re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text, window, classes, allowed):
    text = text or ""
    base = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    taken = list(base)
    for rank, cls in enumerate(classes, 3):
        new = []
        for m in re.finditer(cls.regex, text):
            free = [True] * len(m[0])
            cuts = [(a - m.start(), b - m.start()) for a, _, b, _ in taken]
            cuts += [u.span() for u in UUID.finditer(m[0])]
            cuts += [u.span() for u in re.finditer("|".join(map(re.escape, allowed)), m[0].lower())]
            for a, b in cuts:
                for i in range(max(a, 0), min(b, len(free))):
                    free[i] = False
            for part in re.finditer("1+", "".join("01"[x] for x in free)):
                s, at = m[0][part.start() : part.end()], m.start() + part.start()
                if not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
                    continue
                hits = []
                for i in range(len(s) - window + 1):
                    n = Counter(s[i : i + window])
                    if sum(-c / window * math.log2(c / window) for c in n.values()) >= cls.threshold:
                        hits.append(i)
                if hits:
                    new.append((at + hits[0], rank, at + hits[-1] + window, cls.kind))
        taken += new
    return sorted(base), sorted(taken)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
