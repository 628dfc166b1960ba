"""The chat plan: retrieve, abstain, gate, assemble, ask a model, check its grounding, fall back on what was found.

The model is a function of a prompt that the caller gives; everything else is deterministic. Lists have SOURCES rows at
most when they reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import conversation as C

from . import intent as I
from . import search as S

SOURCES = 3
UNGROUNDED = 0.3  # answers under this grounding are replaced
NOT_FOUND = "Not found in retrieved images"


@dataclass
class Reply:
    answer: str
    confidence: str
    grounded: float
    mode: str  # model, abstained, none, explicit, semantic, neighbours, focus
    sources: list = field(default_factory=list)
    regions: list = field(default_factory=list)


def _value(spark, column):
    """The value of a column built from literals."""
    return spark.range(1).select(column.alias("v")).first()["v"]


def _listed(lead: str, rows: list) -> str:
    return "\n".join([lead, *(f"- {r['id']}: {r['caption']}" for r in rows)])


def reply(
    index: S.Index,
    query: str,
    model: Callable[[str], str] | None = None,
    k: int = 5,
    vector_query: list[float] | None = None,
    image: list[float] | None = None,
    attached=None,
    turns: DataFrame | None = None,
    blocks: DataFrame | None = None,
) -> Reply:
    """Answer a query from an index.

    ``attached`` is the id of an item that the query is about: it is compared with its neighbours (``image`` is its
    vector) where the query asks for a comparison, and answered from alone otherwise. ``turns`` (conv_id, turn, role,
    text) is the conversation so far; a query that points back is searched with the last user's turn. ``blocks``
    (id, pos, text, confidence) are recognised texts, of which those that the query can use join the context.
    """
    spark = index.items.sparkSession
    said = F.lit(query)
    terms, comparison, follows, wide, plain = (_value(spark, c) for c in (C.chat_terms(said), C.is_comparison(said), C.is_follow_up(said), C.expanded(said), C.spelt(said)))
    compare, focus = attached is not None and comparison, attached is not None and not comparison
    if follows and turns is not None and (last := C.last_user_turn(C.history(turns)).select("text").first()):
        wide = f"{wide} (context: {last['text']})"
    found = S.run(index, "" if compare and image else wide, vector_query, max(k, SOURCES + 2) if compare else k, image=image if compare else None)
    policy, intent = found.policy, I.parse(query, index.people)
    sure = found.confidence.select("band").first()
    if sure and sure["band"] == "low" and attached is None:
        top = found.rows.orderBy("rank").limit(SOURCES).collect()
        return Reply(f"I could not find reliable evidence for '{query}'. Try adding attributes, objects or context.", "Low", 0.0, "abstained", top)

    body, relaxed = index.body(), compare or intent.has_constraints or policy.presence_required
    rows = found.rows if attached is None else found.rows.where(F.col("id") != F.lit(attached))
    gated = C.gate(rows, policy.gate, compare, SOURCES if relaxed else 0)
    if policy.lexical == "enforce":
        gated = C.lexical_enforce(gated, C.term_overlap(terms, body)).drop("overlap")
    own = index.items.where(F.col("id") == F.lit(attached)) if attached is not None else None
    if focus:
        sources = own.withColumns({"score": F.lit(1.0), "rank": F.lit(1).cast("long")}).limit(1)
    else:
        sources = gated.orderBy("rank").limit(SOURCES)
    sources = sources.select("id", "caption", "summary", F.array_join("tags", ", ").alias("tags"), "score", "rank", body.alias("text"))
    if blocks is not None:
        usable = C.ocr_budget(blocks.join(F.broadcast(sources.select("id")), "id"), terms)
        read = usable.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"]), " ").alias("read"))
        sources = sources.join(read, "id", "left").withColumn("text", F.concat_ws(" ", "text", "read"))
    listed = sources.orderBy("rank").collect()
    if not listed:
        return Reply(f"{NOT_FOUND} (low similarity).", "Low", 0.0, "none")

    context = "\n".join(f"{r['caption']} {r['summary']} {r['text']}" for r in listed)
    prompt = f"Answer from the context alone; if it doesn't say, answer '{NOT_FOUND}'.\n{context}\n\nQuestion: {plain}"
    answer = model(prompt) if model else NOT_FOUND
    grounded = float(_value(spark, C.grounding(F.lit(answer), F.lit(context))))
    best = max(r["score"] for r in listed)
    missing, mode = NOT_FOUND in answer, "model"
    if focus:
        # the answer may rest on the picture itself
        grounded, mode = (0.0, "focus") if missing else (max(grounded, 0.75), "focus")
        confidence = "Low" if missing else "High"
    else:
        confidence = "High" if grounded > 0.7 else "Medium"
        mentioned = any(t in answer.lower() for t in terms)
        if not missing and grounded < UNGROUNDED and mentioned and best >= 0.75:
            grounded, confidence = max(grounded, 0.45), "Medium"
        elif missing or grounded < UNGROUNDED:
            answer, confidence, grounded, mode = _fallen_back(sources, listed, query, terms, intent, policy, best, compare)
    regions = []
    if blocks is not None:
        said_ = spark.createDataFrame([(r["id"], answer) for r in listed], index.items.select("id").schema.add("answer", "string"))
        regions = C.region_highlight(said_, blocks).collect()
    return Reply(answer, confidence, grounded, mode, listed, regions)


def _fallen_back(sources: DataFrame, listed: list, query: str, terms: list[str], intent: I.Intent, policy: I.Policy, best: float, compare: bool) -> tuple[str, str, float, str]:
    """Answer, confidence, grounding and mode where the model's answer doesn't hold."""
    if compare:
        grounded = min(0.45, best)
        return _listed(f"Closest image-similarity neighbors for '{query}':", listed), "Medium" if grounded >= 0.35 else "Low", grounded, "neighbours"
    required = intent.retrieval_terms if policy.lexical == "enforce" else None
    rows = C.fallback(sources.withColumn("query_id", F.lit(0)), terms, F.col("text"), required).orderBy("place").collect()
    if not rows:
        return NOT_FOUND + ".", "Low", 0.0, "none"
    if rows[0]["mode"] == "explicit":
        held = _value(sources.sparkSession, C.match_score(F.array(*map(F.lit, terms)), F.array(*[F.lit(r["text"]) for r in listed])))
        grounded = max(float(held), rows[0]["overlap"] / max(1, len(terms)), min(0.65, best))
        return _listed(f"Found retrieved images related to '{query}':", rows), "High" if grounded >= 0.7 else "Medium", grounded, "explicit"
    grounded = min(0.40, best * 0.5)
    roles = set(terms).intersection(C.ROLES)
    lead = f"No explicit mention of '{query}' in retrieved metadata. Closest semantic neighbors:" if roles else f"Closest retrieved images for '{query}':"
    return _listed(lead, rows), "Medium" if grounded >= 0.35 else "Low", grounded, "semantic"
