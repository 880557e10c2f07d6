"""Small documents with every awkward case, and plain versions of what operators should do."""

import re

SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source), shorter ones filled with nulls."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, percent=80):
    """{doc_id: smallest doc_id reachable} by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return union_find(pairs, sets)


def line_dedup(rows, least=10):
    """{doc_id: (kept, lines, dropped)}."""
    key = lambda line: line.strip(SPACES).translate(LOWER)
    first, several = {}, set()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least and first.setdefault(k, i) != i:
                several.add(k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in several or first[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out
