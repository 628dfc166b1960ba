"""SQL of the likeness of words, for statements that rank by it: Soundex, indel ratio by recursion, and both together."""

from __future__ import annotations

from tessera.functions.text import SOUNDEX_CODES

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CODES = "".join(next((d for group, d in SOUNDEX_CODES.items() if c in group), "0") for c in _LETTERS)


def soundex_sql(word: str) -> str:
    """The Soundex variant of a SQL expression: runs of one code are one, vowels and H, W end a run."""
    coded = f"translate(upper({word}), '{_LETTERS}', '{_CODES}')"
    runs = coded
    for digit in range(7):
        runs = f"regexp_replace({runs}, '{digit}+', '{digit}', 'g')"
    runs = f"replace({runs}, '0', '')"
    tail = f"CASE WHEN {coded}[1:1] = '0' THEN {runs} ELSE {runs}[2:100] END"
    return f"CASE WHEN regexp_full_match(upper({word}), '[A-Z]+') THEN (upper({word})[1:1] || {tail} || '000')[1:4] ELSE '' END"


def likeness_sql() -> str:
    """Tables lcs and alike (t, w, ratio, likeness) for the words w of table w and the terms t of table asked; needs WITH RECURSIVE."""
    return f"""lcs(t, w, i, j, above, cur) AS (SELECT t, w, 1::BIGINT, 1::BIGINT, list_transform(range(length(t) + 1), lambda x: 0::BIGINT), [0::BIGINT] FROM asked, w WHERE length(t) > 0 AND length(w) > 0 UNION ALL
    SELECT t, w, CASE WHEN j = length(t) THEN i + 1 ELSE i END, CASE WHEN j = length(t) THEN 1 ELSE j + 1 END, CASE WHEN j = length(t) THEN list_append(cur, v) ELSE above END, CASE WHEN j = length(t) THEN [0::BIGINT] ELSE list_append(cur, v) END
    FROM (SELECT *, CASE WHEN substring(w, i, 1) = substring(t, j, 1) THEN above[j] + 1 ELSE greatest(above[j + 1], cur[len(cur)]) END AS v FROM lcs WHERE i <= length(w))),
    ratios AS (SELECT t, w, 2.0::DOUBLE * above[length(t) + 1] / (length(t) + length(w)) AS ratio FROM lcs WHERE i = length(w) + 1),
    alike AS (SELECT t, w, ratio, CASE WHEN t = w THEN 1.0::DOUBLE WHEN {soundex_sql('t')} <> '' AND {soundex_sql('t')} = {soundex_sql('w')} AND t[1:1] = w[1:1] AND length(t) > 1 AND length(w) > 1 AND (t[1:2] = w[1:2] OR right(t, 2) = right(w, 2)) THEN greatest(ratio, 0.86::DOUBLE) ELSE ratio END AS likeness FROM ratios)"""


def fuzzy_sql(name: str, terms: list[str], threshold: float, words: str) -> str:
    """Table ``name`` (id, fuzzy): the mean over the terms of their best likeness to a word of table ``words`` (id, w), from alike."""
    asked = [t for t in dict.fromkeys(terms) if len(t) > 1]
    best = f"SELECT id, t, max(CASE WHEN t = a.w THEN 1.0::DOUBLE WHEN likeness >= {threshold}::DOUBLE THEN likeness ELSE 0 END) AS s FROM {words} x JOIN alike a ON a.w = x.w WHERE length(x.w) > 1 AND t IN ({', '.join(map(repr, asked))}) GROUP BY id, t"
    return f"{name} AS (SELECT id, sum(s) / {len(asked)} AS fuzzy FROM ({best}) GROUP BY id)"
