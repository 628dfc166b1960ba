"""SQL of the search stages over parts, for the statements of the registered searches: weights come from the parsed query."""

from __future__ import annotations

from . import intent as I
from .likeness import fuzzy_sql, likeness_sql
from .search import CROSS_WEIGHT, FUZZY, RETRIEVAL

_WORDS = r"list_distinct(regexp_extract_all(lower(trim(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_brand || ' ' || p_type)), '[\p{L}\p{N}_]+'))"


def _intent(before: str, after: str, intent: I.Intent, w: float, attribute: float, relation: float, penalty: float, boosts: tuple, required: bool) -> tuple[str, list[tuple[str, list[str], float]]]:
    """The CTE of one rerank by intent, and the fuzzy tables that it reads."""
    tables = [(f"{after}_o", [*intent.retrieval_terms, *intent.attribute_terms, *intent.relation_terms], 0.84)]
    parts = []
    for name, terms, threshold, factor in (("a", intent.attribute_terms, 0.84, 1.0), ("c", intent.colors, 0.88, boosts[0]), ("p", intent.patterns, 0.88, boosts[1]), ("y", intent.activity_terms, 0.84, boosts[2])):
        if terms:
            tables.append((f"{after}_{name}", terms, threshold))
            parts.append(f"{factor}::DOUBLE * coalesce({after}_{name}.fuzzy, 0)")
    joins = " ".join(f"LEFT JOIN {t[0]} ON {t[0]}.id = r.id" for t in tables)
    hits = [f"(r.id IN (SELECT id FROM b WHERE w = '{t}'))::INT" for t in intent.presence_terms]
    presence = f"({' + '.join(hits)}) / {len(hits)}::DOUBLE" if hits else str(0.0 if required else 1.0)
    cut = 1.0
    if required and hits:
        cut = max(0.0, 1 - (max(penalty, 0.60) if intent.attribute_terms and intent.retrieval_terms else penalty))
    sql = f"""{after}_x AS (SELECT r.*, least(1, greatest(0, score / CASE WHEN max(score) OVER () > 0 THEN max(score) OVER () ELSE 1 END)) AS vs, coalesce({after}_o.fuzzy, 0) AS so, least(1, greatest(0, {' + '.join(parts) or '0'})) AS ats, {presence} AS ps FROM {before} r {joins}),
    {after}_f AS (SELECT id, rank AS was, so, ats, ps, ({w}::DOUBLE * vs + {1 - w}::DOUBLE * so + {attribute}::DOUBLE * ats + {0.5 * attribute}::DOUBLE * ps) * CASE WHEN ps < 0.5 THEN {cut}::DOUBLE ELSE 1 END AS s FROM {after}_x),
    {after} AS (SELECT id, round(s, 6) AS score, so, ats, ps, row_number() OVER (ORDER BY round(s, 6) DESC, was, id)::BIGINT AS rank FROM {after}_f)"""
    return sql, tables


def search_sql(ctes: str, query: str, k: int | None, more: tuple[str, ...] = (), hybrid: bool = False, cross_depth: int = 0) -> str:
    """The results of a search whose candidates are table found (id, score, rank and, if ``hybrid``, text_score).

    ``more`` are the corrections of misspelt words; ``cross_depth`` the head that the stand-in scorer reranks.
    """
    intent = I.parse(query)
    policy = I.policy(intent)
    alpha, beta = FUZZY.get(policy.query_type, (0.8, 0.2))
    if not more:
        alpha = max(alpha, 0.9)
        beta = min(beta, 1 - alpha)
    a, b = (0.3, 0.7) if hybrid else (0.85, 0.15)
    terms = list(dict.fromkeys([*intent.tokens, *more]))
    tables = [("fuzz", terms, 0.84)]
    stages, last = [], "r1"
    if intent.has_constraints:
        sql, own = _intent("r1", "r2", intent, 0.74, 0.26, 0.2, 0.40, (0.14, 0.14, 0.12), True)
        stages.append(sql)
        tables += own
        last = "r2"
    sql, own = _intent(last, "r3", intent, RETRIEVAL.get(policy.query_type, 0.6), 0.2, 0.2, policy.penalty, (0.2, 0.2, 0.12), policy.presence_required)
    stages.append(sql)
    tables += own
    every = sorted({t for _, ts, _ in tables for t in ts})
    support = "CASE WHEN coalesce(text_score, 0) <> 0 THEN text_score ELSE norm END" if hybrid else "norm"
    typo = f"CASE WHEN max(fuzzy) OVER () >= 0.30 AND fuzzy = 0 THEN s * (0.85::DOUBLE + 0.15::DOUBLE * {support}) ELSE s END" if more else "s"
    own_words = ", ".join(f"'{t}'" for t in intent.tokens)
    crossed = f"""r0 AS (SELECT id, text_score, rank AS was, score AS base, CASE WHEN rank <= {cross_depth} THEN 1 / (1 + exp(-(4.0::DOUBLE * (SELECT count(*) FROM b WHERE b.id = q.id AND b.w IN ({own_words})) / {len(intent.tokens)} - 2))) END AS x FROM q0 q),
    r0b AS (SELECT id, text_score, x, was, base, CASE WHEN x IS NULL THEN base ELSE {1 - CROSS_WEIGHT}::DOUBLE * base + {CROSS_WEIGHT}::DOUBLE * x END AS score FROM r0),
    q1 AS (SELECT id, text_score, score, row_number() OVER (ORDER BY x IS NULL, CASE WHEN x IS NOT NULL THEN -score END, x DESC, CASE WHEN x IS NOT NULL THEN -base END, was) AS rank FROM r0b),""" if cross_depth else "q1 AS (SELECT * FROM q0),"
    return f"""WITH RECURSIVE {ctes}, q0 AS (SELECT id, round(score, 6) AS score, {'text_score' if hybrid else 'NULL::DOUBLE AS text_score'}, row_number() OVER (ORDER BY round(score, 6) DESC, rank, id) AS rank FROM found JOIN part ON p_partkey = id),
    b AS (SELECT p_partkey AS id, unnest({_WORDS}) AS w FROM part WHERE p_partkey IN (SELECT id FROM q0)), w AS (SELECT DISTINCT w FROM b), asked AS (SELECT unnest({every}) AS t), {likeness_sql()},
    {', '.join(fuzzy_sql(name, ts, threshold, 'b') for name, ts, threshold in tables)}, {crossed}
    v AS (SELECT q1.id AS id, rank, text_score, coalesce(fuzzy, 0) AS fuzzy, least(1, greatest(0, score / CASE WHEN max(score) OVER () > 0 THEN max(score) OVER () ELSE 1 END)) AS norm FROM q1 LEFT JOIN fuzz ON fuzz.id = q1.id),
    g AS (SELECT *, {alpha}::DOUBLE * ({a}::DOUBLE * norm + {b}::DOUBLE * ({support})) + {beta}::DOUBLE * fuzzy AS s FROM v), h AS (SELECT id, rank, fuzzy, round({typo}, 6) AS s FROM g),
    r1 AS (SELECT id, s AS score, row_number() OVER (ORDER BY s DESC, fuzzy DESC, rank, id)::BIGINT AS rank FROM h), {', '.join(stages)}
    SELECT rank, r3.id AS id, p_name AS caption, score, round(so, 6) AS semantic_overlap, round(ats, 6) AS attribute_score, round(ps, 6) AS presence_score FROM r3 JOIN part ON p_partkey = r3.id{f' WHERE rank <= {k}' if k else ''}"""
