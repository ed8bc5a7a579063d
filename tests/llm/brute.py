"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, size):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near(rows, size, percent):
    """doc_id -> (n_shingles, component_id); all pairs of distinct sets are compared."""
    sets = {d: shingle_set(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_set = defaultdict(list)
    for d in sorted(sets):
        if sets[d]:
            by_set[sets[d]].append(d)
    reps = [(s, ds[0]) for s, ds in by_set.items()]
    for s, ds in by_set.items():
        for d in ds[1:]:
            a, b = sorted((root(ds[0]), root(d)))
            parent[b] = a
    holders = defaultdict(list)
    for i, (s, _) in enumerate(reps):
        for x in s:
            holders[x].append(i)
    both = Counter()
    for i, (s, _) in enumerate(reps):
        for x in s:
            for j in holders[x]:
                if j > i:
                    both[i, j] += 1
    for (i, j), n in both.items():
        if 100 * n >= percent * (len(reps[i][0]) + len(reps[j][0]) - n):
            a, b = sorted((root(reps[i][1]), root(reps[j][1])))
            parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def repeats(rows, span):
    """doc_id -> (n_bytes, n_removed, n_spans, digest of what is left), by a table of all strings."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + span] for _, b in raw for i in range(len(b) - span + 1))
    out = {}
    for d, b in raw:
        gone = bytearray(len(b))
        upto = 0
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                for j in range(max(i, upto), i + span):
                    gone[j] = 1
                upto = i + span
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def permutation_fill(names, slots):
    """The shard of each slot: in turn, each shard takes the first slot of its own whole permutation that nobody has."""
    orders = []
    for name in names:
        d = hashlib.blake2b(name.encode(), digest_size=16).digest()
        offset, stride = int.from_bytes(d[:8], "little") % slots, int.from_bytes(d[8:], "little") % (slots - 1) + 1
        orders.append([(offset + j * stride) % slots for j in range(slots)])
    assert all(sorted(o) == list(range(slots)) for o in orders)
    taken = {}
    while len(taken) < slots:
        for name, order in zip(names, orders):
            free = next((s for s in order if s not in taken), None)
            if free is not None:
                taken[free] = name
    return [taken[s] for s in range(slots)]


def ordinal_loss(weights, thresholds, rows, grades):
    """Mean negative log likelihood of a cumulative-link model, row by row."""
    import math

    below = lambda k, score: 0.0 if k < 0 else 1.0 if k == len(thresholds) else 1 / (1 + math.exp(score - thresholds[k]))
    total = 0.0
    for row, grade in zip(rows, grades):
        score = sum(weights[f] for f in row)
        total -= math.log(below(grade, score) - below(grade - 1, score))
    return total / len(rows)
