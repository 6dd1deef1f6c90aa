"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def removed(texts, length):
    """{id: (bytes, removed, spans, digest)} for one text per id."""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\x01" * length
            seen.add(w)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(texts, percent=85):
    """{id: (shingles, component)}"""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            where[s].append(i)
    both = collections.Counter((a, b) for at in where.values() for k, a in enumerate(at) for b in at[k + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def contaminated(texts, items, window=13):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        if 0 < len(w) < window:
            windows[tuple(w)].add(str(i))
        for k in range(len(w) - window + 1):
            windows[tuple(w[k : k + window])].add(str(i))
    out = {}
    for i, t in texts.items():
        w = ALNUM.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    found |= x
                    hit |= set(range(k, k + n))
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w))
    return out


def gru_log_probs(model, ids):
    """Natural log probability of each word id in turn, one step and one unit at a time, in doubles."""
    m, n = model.hidden, len(model.x) - 1
    at = lambda a, *i: float(a[i])
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def log_softmax(v, k):
        top = max(v)
        return v[k] - top - math.log(sum(math.exp(x - top) for x in v))

    h, out = [0.0] * m, []
    for i in ids:
        k = len(model.w) if i == n else i // model.per_class
        p = log_softmax([sum(at(model.c, a, j) * h[a] for a in range(m)) + at(model.cb, j) for j in range(len(model.cb))], k)
        if i < n:
            p += log_softmax([sum(at(model.w, k, a, j) * h[a] for a in range(m)) + at(model.wb, k, j) for j in range(model.per_class)], i % model.per_class)
        out.append(p)
        g = [sum(at(model.u, a, j) * h[a] for a in range(m)) + at(model.ub, j) for j in range(3 * m)]
        x = [at(model.x, i, j) for j in range(3 * m)]
        new = []
        for a in range(m):
            z, r = sigmoid(g[a] + x[a]), sigmoid(g[m + a] + x[m + a])
            c = math.tanh(r * g[2 * m + a] + x[2 * m + a])
            new.append((1 - z) * c + z * h[a])
        h = new
    return out
