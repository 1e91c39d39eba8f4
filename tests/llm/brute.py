"""Plain Python versions of what the operators return, one row or one text at a time."""

import hashlib
import math
import re
import zlib
from base64 import b32encode
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def roots(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near(rows, n, percent):
    """{doc_id: (set size, component)}."""
    sets = {d: shingles(t, n) for d, t in rows}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    common = Counter()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                common[a, b] += 1
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    root = roots(sets, links)
    return {d: (len(s), root[d]) for d, s in sets.items()}


def warc(rows):
    groups = defaultdict(list)
    for p, html in rows:
        groups[html or ""].append(p)
    return {
        p: (len((html or "").encode()), b32encode(hashlib.sha1((html or "").encode()).digest()).decode(), "response" if (top := max(groups[html or ""])) == p else "revisit", None if top == p else top)
        for p, html in rows
    }


def base_scores(rows):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    end = object()
    toks = {d: [*words((t or "").translate(LOWER)), end] for d, t in rows}
    c = Counter(x for d, t in toks.items() if crc(d) % 7 != 2 for x in t)
    n, v = sum(c.values()), len(c)
    return {d: (crc(d) % 7 == 2, len(t), sum(c[x] > 0 for x in t), n, math.fsum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in t)) for d, t in toks.items()}


def quality(text):
    w = words(text)
    where = defaultdict(list)
    for i in range(len(w) - 4):
        where[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def luhn(d):
    return sum((2 * x - 9 if x > 4 else 2 * x) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def digits(x):
    return re.sub("[^0-9]", "", x)


SECRETS = (
    ("assign", r"((?ia:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
)
PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
)


def spans(text, kinds):
    """Counts by kind, and the digest of all spans."""
    found = [(m.start(), k, name, m.end()) for k, (name, rx, ok) in enumerate(kinds) for m in re.finditer(rx, text or "") if ok(m)]
    counts = [sum(f[1] == k for f in found) for k in range(len(kinds))]
    listed = [f"{name}:{s}:{e}" for s, _, name, e in sorted(found)]
    return counts, hashlib.sha256(",".join(listed).encode()).hexdigest(), listed


def plain_words(text):
    return re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", (text or "").translate(LOWER))


def overlap(doc, item, least=13, percent=75):
    """Whether some diagonal has a stretch (+1 match, -2 other) of the length and share asked for."""
    x, y = plain_words(doc), plain_words(item)
    if not y:
        return False
    for shift in range(-len(y) + 1, len(x)):
        lo, hi = max(0, -shift), min(len(y), len(x) - shift)
        same = [x[i + shift] == y[i] for i in range(lo, hi)]
        best, start, run, at = 0, 0, 0, (0, 0)
        for i, s in enumerate(same):
            if run <= 0 and s:
                run, start = 0, i
            run += 1 if s else -2
            if run > best:
                best, at = run, (start, i + 1)
        n = sum(same[at[0] : at[1]])
        if best and at[1] - at[0] >= min(least, len(y)) and 100 * n >= percent * (at[1] - at[0]):
            return True
    return False


def removed_lines(rows, percent=80, least=5):
    """{(doc_id, line)} that match an earlier line."""
    sets = []
    for d, t in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        for i, x in enumerate(t.lower().split("\n")):
            s = frozenset(words(x))
            if len(s) >= least:
                sets.append(((d, i), s))
    by, out = defaultdict(list), set()
    for n, (key, s) in enumerate(sets):
        common = Counter(m for w in s for m in by[w])
        if any(100 * c >= percent * (len(s) + len(sets[m][1]) - c) for m, c in common.items()):
            out.add(key)
        for w in s:
            by[w].append(n)
    return out


def entropy(candidate, window):
    """Highest Shannon entropy of a window, counted anew each time."""
    best = -1.0
    for i in range(max(1, len(candidate) - window + 1)):
        part = candidate[i : i + window]
        best = max(best, -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values()))
    return best
