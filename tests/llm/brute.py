"""Plain computations that the operators are held against, and a table of awkward documents."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, b string, `end` string"


def passage(tag, n):
    return [f"{tag}{i}" for i in range(n)]


def awkward():
    """Nulls, empty and very long texts, exact and near copies, repeated rows, shared passages, clashing column names."""
    base, other = passage("alpha", 120), passage("beta", 300)
    shared = " ".join(passage("common", 60))
    near = base[:60] + ["changed"] + base[61:]
    texts = {
        1: " ".join(base),
        2: " ".join(base).upper(),
        3: " ".join(near),
        4: " ".join(other) + "\n" + shared,
        5: shared + " " + " ".join(passage("gamma", 90)),
        6: None,
        7: "",
        8: " \t\n ",
        9: "one two three",
        10: "ONE two  three",
        11: "mail a.b@c.example.org, 10.0.0.255 or 300.1.1.1; 4111 1111 1111 1111 call +1 (202) 555-0100. Straße №5 \U0001f642 x@y.zz",
        12: " ".join(["again and again"] * 40),
        13: " ".join(passage("long", 9000) + base),
        14: "a\nsame line\nsame line\n\n\n# * |\nsame line   no-break",
        15: " ".join(passage("delta", 30) + passage("delta", 30)),
    }
    rows = [(k, t, None if k == 5 else "en" if k % 2 else "de", None if k in (3, 6) else f"s{k % 3}", None if t is None else len(t), "x", None, "y") for k, t in texts.items()]
    return [*rows, rows[0], rows[3], (None, " ".join(base), "en", "s1", 5, None, None, None)]


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(t):
    w = words(lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


class Groups:
    def __init__(self, nodes):
        self.p = {n: n for n in nodes}

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def near(rows):
    rows = [(d, shingles(t)) for d, t in rows]
    g = Groups({d for d, _ in rows if d is not None})
    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                g.join(a, b)
    return sorted(((d, len(s), None if d is None else g.find(d)) for d, s in rows), key=str)


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def private(t):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PII) for m in p.finditer(t or "") if valid(k, m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def deduped(rows, size=20):
    first = {}
    rows = [(1 << 63 if d is None else d, d, words(t)) for d, t in rows]
    for k, _, w in rows:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, (k, i)), (k, i))
    out = []
    for k, d, w in rows:
        gone = {j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < (k, i) for j in range(i, i + size)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def rules(t):
    w = words(t)
    threes = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, duplicates = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), duplicates, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def targets(sizes, weights=(3, 1, 2), ratio=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = ratio * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > cap * sizes[s]]
        if not over:
            return {s: fixed[s] if s in fixed else rest * weight[s] / w for s in order}
        fixed |= {s: cap * sizes[s] for s in over}
