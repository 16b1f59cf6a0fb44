"""Small tables with every awkward row, and brute-force versions of the operators."""

import re

SCHEMA = "doc_id long, text string, source string, component_id string, kept string, slot string"


def docs(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text[, source]) with more columns, named like those of results."""
    full = [(i, t, s[0] if s else "a", "x", "y", "z") for i, t, *s in rows]
    return spark.createDataFrame(full, schema)


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "long " * 30_000), (8, "x" * 50_000),
    (9, "é ß   \U0001F600 ok"), (10, "same text here again"), (10, "same text here again"), (None, "no id at all here"), (None, None),
]
