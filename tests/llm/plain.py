"""Plain Python versions of what the operators compute, and awkward input tables."""

import re
from collections import defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACE = re.compile("[\x20\x09-\x0d]+")
BREAK = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return (text or "").translate(LOWER)


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def terms(text):
    return [w for w in BREAK.split(lower(text)) if w]


def shingle_set(text, k):
    w = words(lower(text))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(docs, k, percent):
    """doc_id -> smallest id reachable, over all pairs."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated_lines(docs, percent, least):
    """doc_id -> numbers of lines that are similar to an earlier one."""
    earlier, out = [], defaultdict(list)
    for i, text in sorted(docs):
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(words(lower(line)))
            if len(s) < least:
                continue
            if any(100 * len(s & t) >= percent * len(s | t) for t in earlier):
                out[i].append(k)
            earlier.append(s)
    return out


def contamination(docs, items):
    """doc_id -> (words, words hit, item ids)."""
    out = {}
    for i, text in docs:
        w, hit, found = terms(text), set(), set()
        for item, item_text in items:
            t = terms(item_text)
            n = min(len(t), 10)
            windows = {tuple(t[s:s + n]) for s in range(len(t) - n + 1)} if n else set()
            for s in range(len(w) - n + 1) if n else ():
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    found.add(item)
        out[i] = (len(w), len(hit), found)
    return out


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    text = "one two three four five six seven eight nine ten eleven twelve " * 6
    rows = [(1, text, "a"), (1, text, "a"), (2, text + "more", "a"), (3, None, "a"), (4, "", None), (5, " \t\n\n ", "b"),
            (6, long, "b"), (7, long + " end", "b"), (None, text, "b"), (None, None, None), (8, "Ärger ÉTÉ 中文 x", "c"),
            (9, "short", "c"), (10, "x\n" * 50, "c"), (11, "Ω" * 3000, "c")]
    return spark.createDataFrame(
        [(i, t, s, 7, "c", 1, True, "p") for i, t, s in rows],
        "doc_id bigint, text string, source string, n_words int, component_id string, copy int, _doc boolean, print string")


def empty_documents(spark):
    return odd_documents(spark).where("false")
