"""PII by weak supervision, in DataFrame expressions alone.

Four base kinds are found by pattern and check, and always stay. Loose forms (spelt-out addresses, national
telephone numbers, social-security numbers) are candidates. For every candidate and base span three labelers vote
-1, 0 or 1: a strict pattern, a gazetteer and the words in front. Counts of votes and span features over all documents
(a table bounded by the votes and features there are) go to the driver. There expectation-maximisation estimates how
often each labeler is right, of what it votes on, in either class; base spans that pass their strict check are known to
be personal data and hold the classes in place. Its posteriors train a logistic span classifier over kind, votes
(weights of one sign, shared by all kinds) and features of the span and what stands around it, which comes back as an
expression and admits or drops candidates. A candidate that every labeler that votes is against is never admitted.

Positions are code points: what lies between the matches, by ``split``, gives where they start. Patterns hold no
loop that backs up or recurses, so a text of one endless run is no harder than another. A null text counts as
empty and has no spans; repeated rows are voted on as often as they stand; without candidates nothing is added;
ties (a chance of exactly one half) are admitted; an empty table gives an empty one; other columns are not read, and
pass through ``mask``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in order, each as a pattern that finds what the plain pattern finds (see the tests).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email_spelt": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++ ?(?:[\[(] ?(?:dot|DOT) ?[\])]|\.) ?[A-Za-z0-9-]++",
    "phone_national": r"(?<![0-9+.()-])(?<![0-9] )\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|[ .-][0-9])",
    "ssn": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|[.-][0-9])",
}
#: What a text must hold for a kind to be looked for: a cheap pattern in front of a dear one.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "email_spelt": r"[\[(] ?(?:at|AT)", "phone_national": r"[0-9]{3}\)?[ .-][0-9]{3}", "ssn": r"[0-9]{3}-[0-9]{2}-"}
KINDS = [*BASE, *LOOSE]
#: Fixed words of the labelers.
PROVIDERS = ["gmail", "yahoo", "hotmail", "outlook", "icloud", "aol", "gmx", "proton", "protonmail", "mail", "web", "live"]
FOR = r"(?i)\b(?:e-?mail|mail|contact|tel|phone|call|fax|mobile|cell|ssn|social|security|card|visa|amex|ip|address|host|write|reach|at)\b[^\n]*$"
AGAINST = r"(?i)\b(?:version|build|isbn|order|item|sku|commit|token|part|serial|model|page|section|release|invoice)\b[^\n]*$"
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
WINDOW = 40
SPAN = "array<struct<kind:string,start:int,end:int,found:string>>"


def _spans(text: str, kind: str) -> Column:
    """All matches of a kind with start and end (columns m_<kind> and p_<kind> hold matches and what lies between)."""
    return F.expr(
        f"""CASE WHEN size(m_{kind}) > 0 THEN aggregate(sequence(0, size(m_{kind}) - 1),
              named_struct('at', 0, 'out', cast(array() as {SPAN})),
              (a, i) -> named_struct('at', a.at + length(p_{kind}[i]) + length(m_{kind}[i]),
                'out', concat(a.out, array(named_struct('kind', '{kind}', 'start', a.at + length(p_{kind}[i]),
                                                        'end', a.at + length(p_{kind}[i]) + length(m_{kind}[i]), 'found', m_{kind}[i])))),
              a -> a.out) ELSE cast(array() as {SPAN}) END"""
    )


def _luhn(digits: str) -> str:
    value = f"cast(substring(reverse({digits}), i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN {value} WHEN {value} > 4 THEN 2 * {value} - 9 ELSE 2 * {value} END) % 10 = 0"


DIGITS = "regexp_replace(s.found, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(s.found, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', ltrim('0', p)) as int) <= 255)",
    "card": _luhn(DIGITS),
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
}


def find(df: DataFrame, text: str, out: str, keys: list[str]) -> DataFrame:
    """``keys``, ``text`` (never null) as t, base spans as ``out`` and candidates as loose."""
    df = df.select(*[F.col(f"`{k}`") for k in keys], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    patterns = BASE | LOOSE
    none = F.array().cast("array<string>")
    found = {}
    for kind, pattern in patterns.items():
        found[kind] = F.when(F.col("t").rlike(NEEDS[kind]), F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none)
    df = df.select("*", *[c.alias(f"m_{k}") for k, c in found.items()])
    df = df.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("t", p, -1)).otherwise(none).alias(f"p_{k}") for k, p in patterns.items()])
    df = df.select(*keys, "t", *[_spans("t", k).alias(f"s_{k}") for k in patterns])
    df = df.select(*keys, "t", F.concat(*[F.expr(f"filter(s_{k}, s -> {VALID[k]})") for k in BASE]).alias(out), F.concat(*[F.col(f"s_{k}") for k in LOOSE]).alias("all_loose"))
    return df.select(*keys, "t", out, F.expr(f"filter(all_loose, c -> NOT exists({out}, s -> s.start < c.end AND c.start < s.end))").alias("loose"))


VOTES = ["strict", "listed", "context"]
FEATURES = ["apart", "size", "varied", "inside", "near"]


def _votes(spans: str) -> str:
    """Each span with its three votes and its features; ``base`` holds the base spans of the text."""
    before = f"substring(t, greatest(s.start - {WINDOW}, 0) + 1, least(s.start, {WINDOW}))"
    domain = "split(substring_index(s.found, '@', -1), '[.]')"
    providers = ", ".join(f"'{p}'" for p in PROVIDERS)
    strict = f"""CASE s.kind
        WHEN 'email' THEN CASE WHEN s.found rlike '[.][A-Za-z]{{2,}}$' AND NOT s.found rlike '^[.]|[.][.]' THEN 1 ELSE -1 END
        WHEN 'ip' THEN CASE WHEN s.found rlike '^(0|25[5-9])|[.]0[.]0[.]0$' THEN -1 ELSE 1 END
        WHEN 'card' THEN CASE WHEN length({DIGITS}) = 16 OR s.found rlike '[ -]' THEN 1 ELSE 0 END
        WHEN 'ssn' THEN CASE WHEN s.found rlike '^(000|666|9)|-00-|-0000$' THEN -1 ELSE 1 END
        WHEN 'phone_national' THEN CASE WHEN s.found rlike '^[(]?[2-9][0-8]' AND s.found rlike '[ .-][2-9][0-9]{{2}}[ .-]' THEN 1 ELSE -1 END
        ELSE 1 END"""
    listed = f"""CASE s.kind
        WHEN 'email' THEN CASE WHEN arrays_overlap({domain}, array({providers})) THEN 1 ELSE 0 END
        WHEN 'email_spelt' THEN CASE WHEN s.found rlike '(?i)\\\\b({'|'.join(PROVIDERS)})\\\\b' THEN 1 ELSE 0 END
        WHEN 'ip' THEN CASE WHEN s.found rlike '^(10|127|192[.]168|169[.]254)[.]' THEN -1 ELSE 0 END
        WHEN 'card' THEN CASE WHEN {DIGITS} rlike '{CARD}' THEN 1 ELSE -1 END
        WHEN 'phone' THEN CASE WHEN s.found rlike '{COUNTRY.replace(chr(92), chr(92) * 2)}' THEN 1 ELSE -1 END
        ELSE 0 END"""
    context = f"CASE WHEN {before} rlike r'{AGAINST}' THEN -1 WHEN {before} rlike r'{FOR}' THEN 1 ELSE 0 END"
    return f"""transform({spans}, s -> named_struct('span', s, 'kind', s.kind, 'strict', {strict}, 'listed', {listed}, 'context', {context},
        'apart', cast(s.found rlike '[ ()-]' as int), 'size', least(4, length(s.found) div 6), 'varied', cast(size(array_distinct(split(regexp_replace(s.found, '[^0-9a-z]', ''), ''))) >= 4 as int),
        'inside', cast(substring(t, s.start, 1) rlike '[A-Za-z0-9]' OR substring(t, s.end + 1, 1) rlike '[A-Za-z0-9]' as int),
        'near', cast(exists(base, b -> b.start <> s.start AND abs(b.start - s.start) < 2 * {WINDOW}) as int)))"""


def _known(kind: str, votes: tuple) -> bool:
    """Base spans that pass their strict check."""
    return kind in BASE and votes[0] == 1


def label_model(counts: dict[tuple, int], rounds: int = 60) -> tuple[dict[tuple, float], np.ndarray, dict[str, float]]:
    """Posterior of each (kind, votes), each labeler's share of right votes in class 0 and 1, and each kind's prior.

    A vote of 0 says nothing. Shares start at 0.8 (as of ten votes) and stay between 0.55 and 0.99, so that votes count
    for what they say and the classes can't change places.
    """
    right, prior, post = np.full((3, 2), 0.8), dict.fromkeys({p[0] for p in counts}, 0.5), {}
    for _ in range(rounds):
        post = {p: 1.0 if _known(p[0], p[1:]) else posterior(prior[p[0]], p[1:], right) for p in counts}
        for i in range(3):
            for cls in (0, 1):
                own = [(n * (post[p] if cls else 1 - post[p]), p[1 + i] == (1 if cls else -1)) for p, n in counts.items() if p[1 + i] and not (i == 0 and _known(p[0], p[1:]))]
                right[i, cls] = np.clip((8 + sum(n for n, ok in own if ok)) / (10 + sum(n for n, _ in own)), 0.55, 0.99)
        for kind in prior:
            own = [(n, post[p]) for p, n in counts.items() if p[0] == kind]
            prior[kind] = float(np.clip((1 + sum(n * x for n, x in own)) / (2 + sum(n for n, _ in own)), 0.05, 0.95))
    return post, right, prior


def posterior(prior: float, votes: tuple, right: np.ndarray) -> float:
    odds = np.log(prior / (1 - prior))
    for v, (no, yes) in zip(votes, right):
        odds += 0 if not v else np.log(yes / (1 - no)) if v > 0 else np.log((1 - yes) / no)
    return float(1 / (1 + np.exp(-odds)))


def _row(kind: str, votes: tuple, features: tuple) -> list[float]:
    return [*(float(kind == k) for k in KINDS), *map(float, votes), *map(float, features)]


def span_classifier(counts: dict[tuple, int], right: np.ndarray, post: dict[tuple, float], rounds: int = 3000) -> np.ndarray:
    """Weights of kinds, votes and features, trained on the posteriors of counted spans (kind, votes, features).

    Every kind also has a light example of each vote that it could get, labelled by the labelers alone, so that votes
    have their weight where a corpus has spans of one class only. Weights of votes are never under 0.
    """
    rows, targets, weights = [], [], []
    for p, n in counts.items():
        rows.append(_row(p[0], p[1:4], p[4:]))
        targets.append(post[p[:4]])
        weights.append(n**0.5)
    mean = np.average([p[4:] for p in counts], axis=0, weights=weights) if counts else np.zeros(len(FEATURES))
    for kind in KINDS:
        for votes in np.ndindex(3, 3, 3):
            votes = tuple(v - 1 for v in votes)
            rows.append(_row(kind, votes, tuple(mean)))
            targets.append(posterior(0.5, votes, right))
            weights.append(0.5)
    x, y, n = np.asarray(rows), np.asarray(targets), np.asarray(weights)
    n = n / n.sum()
    w, own = np.zeros(x.shape[1]), slice(len(KINDS), len(KINDS) + 3)
    w[own] = 1.0
    step = 1 / (0.25 * np.linalg.norm(x * n[:, None] ** 0.5, 2) ** 2 + 1e-3)
    for _ in range(rounds):
        w -= step * (x.T @ (n * (1 / (1 + np.exp(-(x @ w))) - y)) + 1e-3 * w)
        w[own] = np.maximum(w[own], 0.0)
    return w


def chance(w: np.ndarray, kind: str, votes: tuple, features: tuple) -> float:
    return float(1 / (1 + np.exp(-np.dot(w, _row(kind, votes, features)))))


def fit(df: DataFrame, text: str = "text") -> np.ndarray | None:
    """The span classifier of a corpus; None if it has no candidates. The driver gets counts by votes and features."""
    found = find(df.select(text), text, "base", [])
    keys = ["kind", *VOTES, *FEATURES]
    rows = found.select(F.explode(F.expr(_votes("concat(base, loose)"))).alias("v")).groupBy(*[F.col(f"v.{k}").alias(k) for k in keys]).count().collect()
    counts = {tuple(r[k] for k in keys): r["count"] for r in rows}
    if not any(p[0] in LOOSE for p in counts):
        return None
    by_votes: dict[tuple, int] = {}
    for p, n in counts.items():
        by_votes[p[:4]] = by_votes.get(p[:4], 0) + n
    post, right, _ = label_model(by_votes)
    return span_classifier(counts, right, post)


def spans(df: DataFrame, weights: np.ndarray | None, text: str = "text", keys: tuple = ("doc_id",), least: float = 0.5) -> DataFrame:
    """``keys``, t, base and added spans of every row."""
    found = find(df, text, "base", list(keys))
    added = F.expr(f"cast(array() as {SPAN})")
    if weights is not None:
        kinds, rest = weights[: len(KINDS)], weights[len(KINDS) :]
        by_kind = " ".join(f"WHEN '{k}' THEN {float(w)!r}D" for k, w in zip(KINDS, kinds) if k in LOOSE)
        z = " + ".join([f"CASE v.kind {by_kind} END", *(f"{float(w)!r}D * v.{name}" for name, w in zip([*VOTES, *FEATURES], rest))])
        agreed = " OR ".join(f"v.{name} > 0" for name in VOTES)
        silent = " AND ".join(f"v.{name} = 0" for name in VOTES)
        cut = float(np.log(least / (1 - least)))
        added = F.expr(f"transform(filter({_votes('loose')}, v -> ({agreed} OR ({silent})) AND {z} >= {cut!r}D), v -> v.span)")
    return found.select(*keys, "t", "base", added.alias("added"))


def _joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts and digests of the base spans, and all spans, of every document."""
    rows = spans(df, fit(df, text), text, (key,))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        F.col(key).cast("long").alias("doc_id"), *[count(k) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added")
    )


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets; null texts stay null."""
    weights, names = fit(df, text), df.columns
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    own = f"c{names.index(text)}"
    rows = spans(inner, weights, own, tuple(inner.columns)).withColumn("every", F.expr("array_sort(concat(base, added), (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE b.end - a.end END)"))
    masked = F.expr(
        """CASE WHEN size(every) = 0 THEN t ELSE aggregate(every, named_struct('out', '', 'at', 0),
             (a, s) -> CASE WHEN s.end <= a.at THEN a
                            WHEN s.start < a.at THEN named_struct('out', a.out, 'at', s.end)
                            ELSE named_struct('out', concat(a.out, substring(t, a.at + 1, s.start - a.at), '[', upper(s.kind), ']'), 'at', s.end) END,
             a -> concat(a.out, substring(t, a.at + 1))) END"""
    )
    return rows.withColumn(own, F.when(F.col(own).isNotNull(), masked)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
