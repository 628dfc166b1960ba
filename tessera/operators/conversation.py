"""The deterministic parts of the conversational layer, over tables of turns, blocks and results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOLLOW_UPS = ["that", "this", "it", "those", "these", "above", "below", "he", "she", "they"]
#: Fixed words of chat queries: those that are no terms, what terms stand for too, spellings, roles.
CHAT_STOPWORDS = "the and with from this that what when where which show about image images photo photos find for does do did is are am was were have has had there any tell please me can could would should will".split()
EXPANSIONS = {
    "jewelry": "jewellery ornament ornaments necklace bracelet ring earring gold".split(),
    "code": "xml css html json yaml python java programming".split(),
    "programming": "code xml css python java script".split(),
}
SPELLINGS = {"jewelry": "jwellery jewelery jewellery jwellary jewllery".split()}
ROLES = "student students teacher teachers professor professors employee employees intern interns doctor doctors engineer engineers developer developers".split()
FUNCTION_WORDS = ["a", "an", "the", "is", "of", "in"]


def history(turns: DataFrame, last: int = 8) -> DataFrame:
    """The last turns of users and assistants with text, by conversation."""
    good = turns.where(F.lower(F.trim("role")).isin("user", "assistant") & (F.trim("text") != ""))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return good.withColumn("back", F.row_number().over(back).cast("long")).where(F.col("back") <= last)


def last_user_turn(turns: DataFrame) -> DataFrame:
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def is_follow_up(text: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), r"[\s,;.?!]+"), F.array(*map(F.lit, FOLLOW_UPS)))


def ocr_budget(blocks: DataFrame, terms: list[str], least: float = 0.6, budget: int = 3000) -> DataFrame:
    """Blocks (id, pos, text, confidence) that a query can use: certain, on the query or with a digit, distinct, and
    up to the first that breaks the budget of characters."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    overlap = F.arrays_overlap(words, F.array(*map(F.lit, terms))) if terms else F.lit(False)
    kept = blocks.where((F.col("confidence") >= least) & (F.size(words) > 0) & (overlap | F.col("text").rlike("[0-9]")))
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("id", "text").orderBy("pos"))).where("nth = 1")
    run = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("used", F.sum(F.length("text")).over(run).cast("long")).where(F.col("used") <= budget).drop("nth")


def gate(rows: DataFrame, least: float, relaxed: bool = False, fallback: int = 3) -> DataFrame:
    """Rows of each list at the similarity gate (0.35 at most when relaxed); the first ``fallback`` if none is."""
    cut = min(least, 0.35) if relaxed else least
    rows = rows.withColumn("any", F.max("score").over(Window.partitionBy("query_id")) >= cut)
    return rows.where(F.when(F.col("any"), F.col("score") >= cut).otherwise(F.col("rank") <= fallback)).drop("any")


def lexical_enforce(rows: DataFrame, overlap: Column) -> DataFrame:
    """Rows with overlap, in lists where any row has some."""
    rows = rows.withColumn("overlap", overlap).withColumn("most", F.max("overlap").over(Window.partitionBy("query_id")))
    return rows.where("overlap > 0 OR most = 0").drop("most")


def term_overlap(terms: list[str], text: Column) -> Column:
    return sum((F.lower(text).contains(t).cast("long") for t in terms), F.lit(0).cast("long"))


def grounding(answer: Column, context: Column) -> Column:
    """Share of the answer's words that the context has, halved if it lacks one of its numbers."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"(?U)\W+"))
    own = F.array_except(words(answer), F.array(*map(F.lit, FUNCTION_WORDS)))
    numbers = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    share = F.size(F.array_intersect(own, words(context))) / F.size(own)
    missing = F.size(F.array_except(numbers(answer), numbers(context))) > 0
    return F.when(answer.contains("Not found in retrieved images"), 0.0).when(F.size(own) == 0, 0.0).when(missing, share * 0.5).otherwise(share)


def fallback(rows: DataFrame, terms: list[str], text: Column, required: list[str] | None = None, semantic: float = 0.72) -> DataFrame:
    """The two rows an answer falls back on, with mode explicit (words) or semantic (score)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))
    rows = rows.withColumn("overlap", F.size(F.array_intersect(words, F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>"))).cast("long"))
    needed = F.size(F.array_except(F.array(*map(F.lit, required)), words)) == 0 if required else F.lit(True)
    least = 2 if len(terms) >= 3 else 1
    whole = Window.partitionBy("query_id")
    rows = rows.withColumn("hit", needed & (F.col("overlap") >= least)).withColumn("any", F.max(F.col("hit").cast("int")).over(whole) == 1).withColumn("best", F.max("score").over(whole))
    rows = rows.where(F.when(F.col("any"), F.col("hit")).otherwise((F.col("best") >= semantic) & needed))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("any"), F.col("overlap")).otherwise(0).desc(), F.desc("score"), "id")
    rows = rows.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 2")
    return rows.withColumn("mode", F.when(F.col("any"), "explicit").otherwise("semantic")).drop("hit", "any", "best")


def region_highlight(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, needle, pos): the first block that holds each number or name of an answer (id, answer)."""
    needles = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\d+(?:\.\d+)?|\b[A-Z][a-z]{2,}\b"), F.lit(0)))
    asked = answers.select("id", F.explode(needles).alias("needle"))
    return asked.join(blocks, "id").where(F.col("text").contains(F.col("needle"))).groupBy("id", "needle").agg(F.min("pos").alias("pos"))


def chat_terms(query: Column, most: int = 8, expand: bool = True) -> Column:
    """The terms of a chat query: words of three letters or more that say something, each followed by what it stands for."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(CHAT_STOPWORDS))
    if expand:
        known = F.map_from_arrays(F.array(*map(F.lit, EXPANSIONS)), F.array(*[F.array(*map(F.lit, v)) for v in EXPANSIONS.values()]))
        words = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.element_at(known, w), F.array().cast("array<string>")))))
    return F.slice(F.array_distinct(words), 1, most)


def spelt(query: Column) -> Column:
    """The query with known misspellings put right."""
    for right, wrong in SPELLINGS.items():
        query = F.regexp_replace(query, rf"(?i)\b(?:{'|'.join(wrong)})\b", right)
    return query


def expanded(query: Column) -> Column:
    """The query, and on a second line the terms that go with the words it holds."""
    q = F.trim(F.coalesce(query, F.lit("")))
    none = F.array().cast("array<string>")
    also = F.array_distinct(F.concat(*[F.when(F.lower(q).contains(word), F.array(*map(F.lit, more))).otherwise(none) for word, more in EXPANSIONS.items()]))
    return F.when(F.size(also) > 0, F.concat(q, F.lit("\nrelated terms: "), F.array_join(also, ", "))).otherwise(q)


def is_comparison(query: Column) -> Column:
    return F.lower(F.coalesce(query, F.lit(""))).rlike(r"\b(compare|vs|versus|difference|similar|like)\b")


def match_score(terms: Column, texts: Column) -> Column:
    """Share of the terms that any of the texts (an array) holds as a word; 0 without terms or texts."""
    words = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9_]+"), F.lit(0)))))
    return F.when((F.size(terms) > 0) & (F.size(texts) > 0), F.size(F.array_intersect(terms, words)) / F.size(terms)).otherwise(0.0)


def answer_tokens(rows: DataFrame, key: str = "id", answer: str = "answer") -> DataFrame:
    """(key, n, token): an answer in the pieces that a stream of it would send."""
    return rows.select(key, F.posexplode(F.split(answer, " ")).alias("n", "token")).withColumn("token", F.concat("token", F.lit(" ")))


def debounced(queries: DataFrame, wait: float = 0.3, least: int = 3) -> DataFrame:
    """Of the queries that a user types (user_id, ts, text) those that are searched: long enough, not followed by another
    within ``wait`` seconds, and not the same as the last one searched."""
    typed = queries.withColumn("text", F.trim("text"))
    own = Window.partitionBy("user_id").orderBy("ts")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (micros(F.lead("ts").over(own)) - micros(F.col("ts"))) / 1e6
    quiet = typed.withColumn("gap", gap).where((F.col("gap").isNull() | (F.col("gap") >= wait)) & (F.length("text") >= least)).drop("gap")
    return quiet.withColumn("last", F.lag("text").over(own)).where(~F.col("text").eqNullSafe(F.col("last"))).drop("last")


def debounced_stream(queries: DataFrame, wait: float = 0.3, least: int = 3, lateness: str = "1 second") -> DataFrame:
    """``debounced`` of a stream (user_id string, ts timestamp, text): (user_id, ts, text) once nothing can follow within ``wait``.

    Rows that come in another order within ``lateness`` count by their time; later ones are dropped. A user's state is
    what was typed since the watermark, and the text that was searched last.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    micros = round(wait * 1e6)

    def step(key, batches, state: GroupState):
        waiting, last = state.get if state.exists else ([], None)
        waiting = [(w["t"], w["text"]) for w in waiting]
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            waiting += [(int(t), text) for t, text in zip(rows["t"], rows["text"])]
        waiting.sort(key=lambda w: w[0])
        sure = state.getCurrentWatermarkMs() * 1000  # nothing earlier comes any more
        out = []
        while waiting and waiting[0][0] + micros <= sure:
            t, text = waiting.pop(0)
            if (not waiting or waiting[0][0] - t >= micros) and len(text or "") >= least:
                if text != last:
                    out.append((key[0], t, text))
                last = text
        state.update(([{"t": t, "text": text} for t, text in waiting], last))
        if waiting:
            state.setTimeoutTimestamp(max((waiting[0][0] + micros) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "t", "text"])

    typed = queries.withWatermark("ts", lateness).select("user_id", "ts", F.unix_micros("ts").alias("t"), F.trim("text").alias("text"))
    found = typed.groupBy("user_id").applyInPandasWithState(step, "user_id string, t long, text string", "waiting array<struct<t: long, text: string>>, last string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("user_id", F.timestamp_micros("t").alias("ts"), "text")
