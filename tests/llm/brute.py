"""Plain versions of the operators, slow and obvious."""

from __future__ import annotations

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


def shingles(text: str | None, size: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(docs: dict[int, str | None], size: int, percent: int = 80) -> dict[int, int]:
    sets = {d: shingles(t, size) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = collections.defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by_shingle[x].add(d)
    for d, s in sets.items():
        for e in {e for x in s for e in by_shingle[x] if e < d}:
            common = len(s & sets[e])
            if 100 * common >= percent * (len(s) + len(sets[e]) - common):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: root(d) for d in docs}


def repeats(rows: list[bytes], length: int) -> list[tuple]:
    seen = collections.Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    out = []
    for t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def scores(docs: list[str | None], order: int = 3, held_out: bool = True, backoff: float = 0.4) -> list[tuple]:
    texts = [words(t) for t in docs]
    grams = [collections.Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in texts]
    seen, out = collections.Counter(), []
    for g in grams:
        seen.update(g)
    total = sum(map(len, texts))
    for w, g in zip(texts, grams, strict=True):
        count = lambda x: seen[x] - held_out * g[x]  # noqa: B023, E731
        score, steps = 0.0, 0
        for i in range(len(w)):
            n = min(order, i + 1)
            while n > 1 and not count(tuple(w[i - n + 1 : i + 1])):
                n, steps, score = n - 1, steps + 1, score + math.log(backoff)
            gram = tuple(w[i - n + 1 : i + 1])
            score += math.log(count(gram) / count(gram[:-1]) if n > 1 else max(count(gram), 1) / max(total - held_out * len(w), 1))
        out.append((len(w), steps, score))
    return out


def statistics(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def private(text: str | None) -> list[tuple]:
    t = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def secrets(text: str | None) -> list[tuple]:
    t = text or ""
    assign = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, t, re.I | re.A) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def linked_secrets(text: str | None, kinds: list, scope: int) -> list[tuple]:
    """All spans: the strong ones, and each weak one with a counterpart that stands apart from it within scope."""
    t = text or ""
    base = secrets(t)
    found = [(m.start(), i, m.end()) for i, k in enumerate(kinds) if k.weak for m in re.finditer(k.pattern, t, re.A) if len(m[k.group]) >= k.least]
    overlap = lambda a, b: a[0] < b[2] and b[0] < a[2]
    role = lambda s: kinds[s[1]].role
    sites = [s for s in found if role(s) == "endpoint"]
    found = [s for s in found if not (kinds[s[1]].name == "key" and any(overlap(s, x) for x in sites)) and not any(overlap(s, b) for b in base)]
    fits = lambda a, b: (role(a) == "secret") != (role(b) == "secret") and not overlap(a, b) and max(a[0] - b[2], b[0] - a[2]) <= scope
    return sorted(base + [s for s in found if any(fits(s, x) for x in base + found)])
