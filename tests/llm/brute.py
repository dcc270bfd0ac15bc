"""Plain Python versions of the operators."""

import collections
import re

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(sets, percent=75):
    """Smallest linked id of every id."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    pairs = collections.Counter((a, b) for ids in index.values() for n, b in enumerate(ids) for a in ids[:n])
    for (a, b), both in pairs.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in sets}


def duplicate_lines(docs, percent=75):
    """(id, line) of lines that an earlier line matches; docs: (id, text) in order of id."""
    index, sizes, gone = collections.defaultdict(list), [], set()
    for i, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            w = words(line)
            s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
            if not s:
                continue
            counts = collections.Counter(m for x in s for m in index[x])
            if any(c * 100 >= percent * (len(s) + sizes[m] - c) for m, c in counts.items()):
                gone.add((i, n))
            for x in s:
                index[x].append(len(sizes))
            sizes.append(len(s))
    return gone


def without(text, gone):
    return None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)


def contained(docs, items, percent=75):
    """(id, item) pairs of items with enough shingles in a document."""
    sets = {i: shingles(t) for i, t in items}
    out = set()
    for d, t in docs:
        s = shingles(t)
        out |= {(d, i) for i, q in sets.items() if q and len(q & s) * 100 >= percent * len(q)}
    return out
