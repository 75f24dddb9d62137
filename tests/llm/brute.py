"""Plain re-statements of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash


def repeats(docs, length=50):
    """doc_id, bytes -> {(doc_id, text): (n_bytes, n_removed, n_spans, sha256)}."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        k = float("inf") if i is None else i
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if k < first.get(s, (float("inf"), 0))[0] or s not in first:
                first[s] = (k, 0)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        k = float("inf") if i is None else i
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]][0] < k:
                gone[p : p + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    """Smallest reachable id of each place, by union-find over all pairs that ``linked`` names."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    least = defaultdict(list)
    for i in range(len(ids)):
        least[find(i)].append(ids[i])
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


def near_fingerprints(fps, bits=3):
    x = np.array(fps, np.uint64)
    return [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= bits) if j > i]


def near_pairs(texts):
    """Pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else {()}))
    return [(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if 5 * len(a & (b := sets[j])) >= 4 * len(a | b)]


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def secrets(text):
    t, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", t):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end(), "hex"))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def targets(sizes, weights=(5, 2, 1), cap=3):
    """source -> target by repeated sharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, got, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left, weight = total - sum(got.values()), sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / weight > cap * sizes[s]}
        if not over:
            got |= {s: left * w[s] / weight for s in open_}
            break
        got |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return got
