"""Plain versions of the text operators, for small inputs; they share no code with the library."""

import hashlib
import re
from collections import Counter, defaultdict

WS = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(x):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), x or "")


def words(x, pattern):
    return re.findall(pattern, x or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def shingles(text, n):
    w = words(lower(text), WS)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_duplicates(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in by[x] if j < i)
        for j, k in both.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min(least[find(i)], default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return out


def quality_base(text):
    w = words(text, WS)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WS, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def suffix_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, sha(rest)))
    return out


def license_base(text):
    w = words(lower(text), ALNUM)
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def contamination(text, items):
    w = words(lower(text), ALNUM)
    hit, names = set(), set()
    at = defaultdict(list)
    for n in range(1, 11):
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].append(i)
    for name, t in items:
        v = words(lower(t), ALNUM)
        n = min(10, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            for s in at.get(tuple(v[i : i + n]), ()):
                hit |= set(range(s, s + n))
                names.add(str(name))
    return len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii_base(text):
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    found.sort()
    n = Counter(k for *_, k in found)
    return n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in found))
