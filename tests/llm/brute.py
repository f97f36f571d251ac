"""Brute-force versions of the contracts, over lists of (doc_id, text)."""

import hashlib
import re


def byte_dedup(rows, length=50):
    texts = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in texts:
        if d is not None:
            for i in range(len(b) - length + 1):
                s = b[i:i + length]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - length + 1):
                if first[b[i:i + length]] < d:
                    gone[i:i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def word_dedup(rows, length=13):
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in texts:
        if d is not None:
            for i in range(len(w) - length + 1):
                s = tuple(w[i:i + length])
                first[s] = min(first.get(s, d), d)
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - length + 1):
                if first[tuple(w[i:i + length])] < d:
                    gone[i:i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near_components(rows, words=5, percent=75):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j > i}:
            both = len(s & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                root[b] = a
        seen.add(i)
    return [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, _), s in zip(rows, sets)]


def decontaminated(docs, items, span=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(len(w), span)
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i:i + n]))
                if got:
                    found |= got
                    hit |= set(range(i, i + n))
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def luhn(digits):
    odd = [int(c) for c in digits[::-1]]
    return sum(odd[::2] + [sum(divmod(2 * d, 10)) for d in odd[1::2]]) % 10 == 0


def private(text):
    """Base spans by the patterns as they are stated."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    names = ("email", "ip", "card", "phone")
    return sorted(found), ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found))


def mixture(leaves, budget):
    """{path: budget} of {path: (weights..., cap)} by pouring in proportion until a child is full."""
    from fractions import Fraction

    def split(pot, kids):
        pot, out, left = min(pot, sum(c for _, c in kids.values())), {}, dict(kids)
        while left:
            total = sum(w for w, _ in left.values())
            rest = pot - sum(out.values())
            full = [k for k, (w, c) in left.items() if c <= Fraction(w * rest, total)]
            if not full:
                part = {k: w * rest // total for k, (w, c) in left.items()}
                for k in sorted(part, key=lambda k: (k is not None, k))[:rest - sum(part.values())]:
                    part[k] += 1
                return out | part
            # The fullest child first: its share never shrinks as others fill up.
            k = min(full, key=lambda k: (Fraction(left[k][1], left[k][0]), k is not None, k))
            out[k] = left.pop(k)[1]
        return out

    def down(pot, depth, group):
        if depth == len(next(iter(group))):
            (path,) = group
            return {path: pot}
        kids = {}
        for path, value in group.items():
            w, c = kids.get(path[depth], (value[depth], 0))
            kids[path[depth]] = (w, c + value[-1])
        out = {}
        for k, part in split(pot, kids).items():
            out |= down(part, depth + 1, {p: v for p, v in group.items() if p[depth] == k})
        return out

    return down(budget, 0, leaves) if leaves else {}
