"""Query understanding: intent, policy, router and depth budgets, of one query on the driver or of a table of queries as columns."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

# Fixed word lists of the query language.
STOPWORDS = set("the a an in on at to of is are was were what which show find any image images photo photos there where does do did having".split())
PERSON_TERMS = set("person people man men woman women boy girl male female couple family elderly senior old".split())
CLOTHING_TERMS = set("shirt tshirt tee kurta sari saree dress jacket coat pant pants trouser trousers uniform robe".split())
COLOR_TERMS = set("white black red green blue yellow orange pink purple brown gray grey gold silver beige".split())
PATTERN_TERMS = set("check checked checkered plaid stripe striped".split())
ACTIVITY_TERMS = set("meal eating eat dining dinner lunch breakfast walking holding sitting standing".split())
AGE_TERMS = set("old elderly senior aged".split())
CUE_TERMS = set("color colour pattern age activity style".split())
IDENTITY_CUES = set("named person people photo photos picture pictures".split())
SYNONYMS = {"old": ["elderly", "senior", "aged"], "elderly": ["old", "senior", "aged"], "check": ["checkered", "checked", "plaid"], "checkered": ["check", "checked", "plaid"]}
RELATIONS = {
    "next_to": ["next to", "beside", "near", "alongside"],
    "behind": ["behind", "at the back of"],
    "in_front_of": ["in front of", "ahead of"],
    "holding": ["holding", "holds", "carrying"],
    "wearing": ["wearing", "wears", "dressed in"],
    "eating": ["eating", "having meal", "dining", "having lunch", "having dinner"],
    "with": ["with"],
}
RELATION_WORDS = {w for aliases in RELATIONS.values() for a in aliases for w in a.split()}
OCR_WORDS = ["invoice", "receipt", "extract text", "amount", "convert to latex", "number", "total", "document", "bill"]
VISUAL_WORDS = ["similar", "looks like", "style", "layout", "poster", "design", "hoarding", "diagram"]
NAME = re.compile(r"\b[A-Z][a-z]{2,}\b")


def distinct(values) -> list[str]:
    return [v for v in dict.fromkeys(values) if v]


def normalised(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").strip().lower()


def tokens(text: str) -> list[str]:
    return distinct(re.findall(r"\w+", normalised(text)))


@dataclass(frozen=True)
class Intent:
    raw: str
    tokens: list[str] = field(default_factory=list)
    retrieval_terms: list[str] = field(default_factory=list)
    attribute_terms: list[str] = field(default_factory=list)
    relation_terms: list[str] = field(default_factory=list)
    presence_terms: list[str] = field(default_factory=list)
    colors: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    activity_terms: list[str] = field(default_factory=list)
    name_terms: list[str] = field(default_factory=list)
    require_person: bool = False
    require_presence: bool = False
    query_type: str = "generic"
    certainty: float = 0.7

    @property
    def has_constraints(self) -> bool:
        return bool(self.attribute_terms or self.relation_terms or self.require_person or self.require_presence)


#: What a query can be, the first sign that it bears first: kind, certainty without and with enough to go on.
KINDS = (("identity", 0.72, 0.90), ("constrained", 0.74, 0.88), ("attribute", 0.68, 0.82), ("generic", 0.58, 0.70))
MIXED, LEAST = 0.12, 0.45  # what a second sign takes off, and down to what
_SEVERAL = re.compile(r"(?<![^ ])and(?![^ ])|,")


def _kind(borne: tuple[bool, bool, bool], enough: tuple[bool, bool, bool, bool]) -> tuple[str, float]:
    """Kind and certainty of a query by the signs that it bears; one that bears none is generic."""
    first = borne.index(True) if any(borne) else 3
    name, *levels = KINDS[first]
    certainty = levels[enough[first]]
    return name, max(LEAST, certainty - MIXED) if sum(borne) > 1 else certainty


def parse(query: str, people: bool = True) -> Intent:
    """What a query asks for: its words sorted into what they say, and its kind by the signs these make.

    Without ``people`` (items can't show any) no word asks for a person, and one like old is an attribute alone.
    """
    raw, normal, words = query or "", normalised(query), tokens(query)
    said = {name: [w for w in words if w in known] for name, known in (("color", COLOR_TERMS), ("pattern", PATTERN_TERMS), ("clothing", CLOTHING_TERMS), ("activity", ACTIVITY_TERMS), ("age", AGE_TERMS), ("cue", CUE_TERMS))}
    own = [w for name in ("color", "pattern", "clothing", "activity", "age") for w in said[name]]
    attributes = distinct([*distinct(own), *(s for w in distinct(own) for s in SYNONYMS.get(w, [])), *said["cue"]])
    relations = [name for name, aliases in RELATIONS.items() if any(a in normal for a in aliases)]
    rest = [w for w in words if w not in STOPWORDS | RELATION_WORDS | set(attributes)]
    capital = [n.lower() for n in NAME.findall(raw)]
    names = distinct(n for n in capital if n not in STOPWORDS)
    several = bool(relations or _SEVERAL.search(normal))
    presence = several or bool(attributes and rest)
    two = len(rest) > 1
    borne = (bool(names or (capital and IDENTITY_CUES.intersection(words))), bool(relations) or (presence and two), bool(attributes))
    kind, certainty = _kind(borne, (bool(names), two, bool(rest), len(rest) < 3))
    return Intent(
        raw, words, rest, attributes, relations, rest[: 1 + several], said["color"], said["pattern"], said["activity"], names, people and not (PERSON_TERMS | CLOTHING_TERMS).isdisjoint(words), presence, kind, certainty
    )


@dataclass(frozen=True)
class Policy:
    query_type: str
    gate: float
    multiplier: float
    lexical: str
    presence_required: bool
    penalty: float
    w_clip: float
    w_text: float


def policy(intent: Intent, base: float = 0.60, swing: float = 0.07, penalty: float = 0.35, most: float = 2.0, fallback: float = 0.55, adaptive: bool = True) -> Policy:
    """How a query of this kind is searched."""
    kind = intent.query_type if intent.certainty >= fallback else "generic"
    clamp = lambda x: max(0.0, min(1.0, x))
    if not adaptive:
        return Policy("generic", clamp(base), 1.0, "boost", intent.require_presence, penalty, 0.60, 0.40)
    rows = {
        "generic": (-swing, 2.0, "boost", False, min(penalty, 0.20), 0.60, 0.40),
        "constrained": (0.7 * swing, 1.25, "enforce", True, max(penalty, 0.45), 0.62, 0.38),
        "attribute": (0.0, 1.5, "boost", intent.require_person or intent.require_presence, max(penalty, 0.35), 0.45, 0.55),
        "identity": (0.35 * swing, 1.5, "enforce", False, max(penalty, 0.25), 0.35, 0.65),
    }
    adjust, multiplier, *rest = rows[kind]
    return Policy(kind, clamp(base + adjust), min(multiplier, most), *rest)


def route(query: str) -> str:
    """text, clip or hybrid, by the words of a query."""
    q = (query or "").lower()
    text, visual = any(w in q for w in OCR_WORDS), any(w in q for w in VISUAL_WORDS)
    return "text" if text and not visual else "clip" if visual and not text else "hybrid"


def route_column(text: Column) -> Column:
    """``route`` for a column of queries."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    read, seen = has(OCR_WORDS), has(VISUAL_WORDS)
    return F.when(read & ~seen, "text").when(seen & ~read, "clip").otherwise("hybrid")


def terms_column(text: Column) -> dict[str, Column]:
    """Attribute and retrieval terms and relations for a column of queries, by set operations on its words."""
    words = X.unicode_tokens(X.nfkc(text))
    among = lambda known: F.array_intersect(words, F.array(*map(F.lit, sorted(known))))
    own = reduce(F.array_union, map(among, (COLOR_TERMS, PATTERN_TERMS, CLOTHING_TERMS, ACTIVITY_TERMS, AGE_TERMS)))
    more = [F.when(F.array_contains(own, w), F.array(*map(F.lit, also))).otherwise(F.array().cast("array<string>")) for w, also in SYNONYMS.items()]
    attributes = F.array_union(reduce(F.array_union, more, own), among(CUE_TERMS))
    normal = F.lower(F.trim(X.nfkc(text)))
    named = [F.when(reduce(lambda a, b: a | b, [normal.contains(x) for x in aliases]), name) for name, aliases in RELATIONS.items()]
    rest = F.array_except(F.array_except(words, F.array(*map(F.lit, sorted(STOPWORDS | RELATION_WORDS)))), attributes)
    return {"attribute_terms": attributes, "retrieval_terms": rest, "relation_terms": F.array_compact(F.array(*named))}


def candidate_depth(k: int) -> int:
    return min(max(4 * k, 40), 200)


def policy_depth(k: int, multiplier: float) -> int:
    return max(20 if k < 20 else k, math.ceil(k * multiplier))


def rerank_depth(k: int, n_tokens: int, keyword_hits: int, rows: int) -> int:
    depth = min(max(2 * k, 12), 40)
    if n_tokens > 8:
        depth = max(2, round(0.7 * depth))
    if keyword_hits > 80:
        depth = min(depth, 20)
    return max(0, min(depth, rows))


def _listed(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def understood(queries: DataFrame, text: str = "text", people: bool = True) -> DataFrame:
    """``parse``, ``policy`` and ``route`` of a table of queries, as columns beside its own; a null text is an empty one."""
    among = lambda known: F.array_intersect("tokens", _listed(sorted(known)))
    has = lambda c: F.size(c) > 0
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = queries.withColumn("normal", F.lower(F.regexp_replace(X.nfkc(raw), r"(?U)^\s+|\s+$", "")))
    rows = rows.withColumn("tokens", F.array_distinct(F.regexp_extract_all("normal", F.lit(r"(?U)\w+"), F.lit(0))))
    rows = rows.withColumns({"colors": among(COLOR_TERMS), "patterns": among(PATTERN_TERMS), "activity_terms": among(ACTIVITY_TERMS)})
    own = F.array_distinct(F.concat("colors", "patterns", among(CLOTHING_TERMS), "activity_terms", among(AGE_TERMS)))
    synonyms = F.create_map(*[x for w, also in SYNONYMS.items() for x in (F.lit(w), _listed(also))])
    also = F.flatten(F.transform("own", lambda w: F.coalesce(synonyms[w], _listed([]))))
    rows = rows.withColumn("own", own).withColumn("attribute_terms", F.array_distinct(F.concat("own", also, among(CUE_TERMS)))).drop("own")
    named = [F.when(reduce(lambda a, b: a | b, [F.col("normal").contains(x) for x in aliases]), name) for name, aliases in RELATIONS.items()]
    capital = F.transform(F.regexp_extract_all(raw, F.lit("(?U)\\b[A-Z][a-z]{2,}\\b"), F.lit(0)), F.lower)
    rows = rows.withColumns({"relation_terms": F.array_compact(F.array(*named)), "retrieval_terms": F.array_except(F.array_except("tokens", _listed(sorted(STOPWORDS | RELATION_WORDS))), F.col("attribute_terms")), "capital": capital})
    several = has("relation_terms") | F.col("normal").rlike(_SEVERAL.pattern)
    two, presence = F.size("retrieval_terms") > 1, F.col("require_presence")
    rows = rows.withColumns({"name_terms": F.array_distinct(F.array_except("capital", _listed(sorted(STOPWORDS)))), "presence_terms": F.slice("retrieval_terms", 1, F.when(several, 2).otherwise(1)), "require_presence": several | (has("attribute_terms") & has("retrieval_terms")), "require_person": has(among(PERSON_TERMS | CLOTHING_TERMS)) & F.lit(people)})
    borne = [has("name_terms") | (has("capital") & has(among(IDENTITY_CUES))), has("relation_terms") | (presence & two), has("attribute_terms")]
    enough = [has("name_terms"), two, has("retrieval_terms"), F.size("retrieval_terms") < 3]
    first = lambda values: F.when(borne[0], values[0]).when(borne[1], values[1]).when(borne[2], values[2]).otherwise(values[3])
    certainty = first([F.when(e, high).otherwise(low) for e, (_, low, high) in zip(enough, KINDS)])
    signs = reduce(lambda a, b: a + b, [b.cast("int") for b in borne])
    rows = rows.withColumns({"query_type": first([F.lit(name) for name, _, _ in KINDS]), "certainty": F.when(signs > 1, F.greatest(F.lit(LEAST), certainty - MIXED)).otherwise(certainty), "has_constraints": borne[2] | has("relation_terms") | F.col("require_person") | presence})
    return rows.drop("normal", "capital")


def policies(rows: DataFrame, **settings) -> DataFrame:
    """The policy of each ``understood`` query, as columns: what ``policy`` says of each kind of query, and of what a query needs."""
    kinds = {name: [policy(Intent("", query_type=name, certainty=1.0, require_presence=need), **settings) for need in (False, True)] for name, _, _ in KINDS}
    least = settings.get("fallback", 0.55)
    need = F.col("require_presence") if not settings.get("adaptive", True) else F.col("require_person") | F.col("require_presence")
    kind = F.when(F.col("certainty") >= least, F.col("query_type")).otherwise("generic")

    def value(field_: str) -> Column:
        choose = lambda i: reduce(lambda out, n: F.when(kind == n, F.lit(getattr(kinds[n][i], field_))).otherwise(out), list(kinds)[1:], F.lit(getattr(kinds["identity"][i], field_)))
        return F.when(need, choose(1)).otherwise(choose(0))

    return rows.withColumns({"kind": value("query_type"), **{f: value(f) for f in ("gate", "multiplier", "lexical", "presence_required", "penalty", "w_clip", "w_text")}, "route": route_column(F.col("text"))})
