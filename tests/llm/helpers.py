"""Plain versions of the operators, and awkward tables."""

import collections
import re

LONG = "word " * 30_000
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (4, "x" * 60_000),
    (5, LONG),
    (6, "One two three four. One two three four."),
    (6, "One two three four. One two three four."),
    (None, "no id at all"),
    (7, "mail a.b@c.de or +1 (017) 555-7713, 4111 1111 1111 1111 and 10.0.0.1"),
    (8, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" stands here'),
    (9, "Ünï cödé \U0001f600 <|endoftext|> a   b\r\n\r\n"),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def docs(spark, rows=AWKWARD):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)


def labels(spark, rows=((6, 1, 0), (7, 1, 0), (8, 0, 1), (None, 1, 1))):
    return spark.createDataFrame(list(rows), LABELS)


def clashing(df):
    """Columns with the names that operators use themselves."""
    from pyspark.sql import functions as F

    names = "score key kept sample_key log_weight gone_id sid n media payload piece start length salt bucket c0 t base added unmasked mark found before".split()
    return df.withColumns({c: F.lit(c) for c in names})


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_classes(rows, width, percent):
    """doc_id -> (set size, smallest doc_id reachable), by all pairs that share a shingle."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    common = collections.Counter((a, b) for ids in holders.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def luhn(digits):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    text, out = text or "", []
    out += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]
