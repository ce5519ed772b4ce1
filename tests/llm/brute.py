"""Brute-force versions of the corpus operators, straight from their definitions."""

import hashlib
import re
from collections import Counter

NO_ID = 1 << 62


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else bytes(data)).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def known(doc_id):
    return NO_ID if doc_id is None else doc_id


def suffix_dedup(rows, span=50):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - span + 1):
            window = data[p : p + span]
            first[window] = min(first.get(window, NO_ID), known(i))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - span + 1):
            if first[data[p : p + span]] < known(i):
                gone[p : p + span] = b"\1" * span
        starts = sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1]))
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), starts, sha(kept)))
    return out


def substring_dedup(rows, span=35):
    found, texts = Counter(), [words(text) for _, text in rows]
    for w in texts:
        found.update(tuple(w[p : p + span]) for p in range(len(w) - span + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = [0] * len(w)
        for p in range(len(w) - span + 1):
            if found[tuple(w[p : p + span])] > 1:
                gone[p : p + span] = [1] * span
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept)))
    return out


def exact_dedup(rows):
    groups = {}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", text or "") for _, text in rows]
    for (i, _), t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, sha(t)))
    return out


def near_duplicates(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        w = words((text or "").translate(lower))
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set())
    holders = {}
    for k, s in enumerate(sets):
        for item in s:
            holders.setdefault(item, []).append(k)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        shared = Counter(j for item in s for j in holders[item])
        for j, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), NO_ID), i)
    return [(i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)]


def luhn(digits):
    total = 0
    for at, c in enumerate(reversed(digits)):
        value = int(c) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def personal_base(text):
    text, found = text or "", []

    def digits(match):
        return re.sub("[^0-9]", "", match.group())

    for kind, pattern, passes in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if passes(m)]
    return found


def secret_base(text):
    text, found = text or "", []
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, pattern, group, least in (("assign", assign, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return found


def repetition(text, min_repeat):
    text = text or ""
    w = words(text)
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    repeated = {i + k for i in range(len(w)) if best[i] >= 3 for k in range(3)}
    covered = {i + k for i in range(len(w)) if best[i] >= min_repeat for k in range(best[i])}
    lines = [line for line in text.split("\n") if words(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated), len(covered), max(best, default=0)
