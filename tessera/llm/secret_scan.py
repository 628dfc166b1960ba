"""Secret scans: candidates by pattern, and a random forest that removes false positives, in DataFrame expressions.

Candidates are runs of LEAST characters or more of the alphabets that keys use, with a digit, and values of 6 characters
or more that are assigned to a credential's name (these may hold symbols and need no digit). A name in front of an
assignment is no part of a candidate. The forest looks at a candidate's length, entropy, changes of character class,
how likely its letters follow one another in words of the corpus, how much of it the corpus's frequent words cover, the
path or source it stands in and the words on both sides. What it knows of words is counted over the whole corpus: the
transitions of letters in all words, and the DICTIONARY words of four letters or more that most texts hold (ties by
the word). It is trained on labelled findings (text, source, label); ``sample_findings`` makes a fixed set of them,
since no table here labels any.

Null texts count as empty and have no candidates; very long texts are read whole; repeated rows get equal results, and
rows of one id go by their texts; a corpus without words has even transitions and an empty dictionary; an empty table
gives an empty one; other columns are not read. Candidates are few, and only they, row keys and counts of words are
shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

FINDINGS = 6_000
TREES, DEPTH, SEED = 24, 8, 7
CUT = 0.5
WINDOW, LEAST, DICTIONARY = 48, 16, 400
CREDENTIAL = r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)"
#: A long run of key characters with a digit (base64 may end in '='), and a value assigned to a credential's name.
LONG = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}"
VALUE = rf"(?i)(?<=\b{CREDENTIAL}[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"']?)(?<![^\s\"':=])[^\s\"'<>,;=:]{{6,}}+"
FEATURES = ["size", "entropy", "changes", "likely", "kinds", "digits", "upper", "hex", "symbols", "covered", "assigned", "named", "against", "quoted", "named_after", "against_after", "config"]
SPAN = "array<struct<start:int,end:int,found:string>>"


@dataclass
class Words:
    """What the corpus says of words: log probabilities of letter after letter (27 x 27, others than a-z as one), and frequent words."""

    transitions: list[float] = field(default_factory=lambda: [-3.3] * 729)
    frequent: list[str] = field(default_factory=list)


def _codes(text: Column) -> Column:
    return F.transform(F.split(F.lower(text), ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).otherwise(26))


def learn_words(df: DataFrame, text: str = "text", most: int = DICTIONARY) -> Words:
    """Counts over all words of all texts; the driver gets 729 transitions and ``most`` words."""
    words = df.select(F.explode(F.split(F.lower(F.col(text)), "[^a-z]+")).alias("word")).where("length(word) between 3 and 24").groupBy("word").agg(F.count("*").alias("n"))
    words = written(words, "words")
    pairs = words.select(F.expr("explode(transform(sequence(1, length(word) - 1), i -> 27 * (ascii(substring(word, i, 1)) - 97) + ascii(substring(word, i + 1, 1)) - 97))").alias("pair"), "n")
    counts = {r[0]: r[1] for r in pairs.groupBy("pair").agg(F.sum("n")).collect()}
    table = []
    for a in range(27):
        total = sum(counts.get(27 * a + b, 0) for b in range(27))
        table += [math.log((counts.get(27 * a + b, 0) + 1) / (total + 27)) for b in range(27)]
    frequent = words.where("length(word) >= 4").orderBy(F.desc("n"), "word").limit(most).collect()
    return Words(table, [r["word"] for r in frequent])


def candidates(df: DataFrame, keys: list[str], words: Words, text: str = "text", source: str | None = "source") -> DataFrame:
    """``keys``, start, end, found and FEATURES of every candidate."""
    path = F.col(source) if source else F.lit(None).cast("string")
    df = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(path, F.lit("")).alias("path"))
    none = F.array().cast("array<string>")
    # dear patterns run behind cheap ones, and values only where something is assigned
    assigns = F.when(F.col("t").contains("=") | F.col("t").contains(":"), F.col("t").rlike(rf"(?i){CREDENTIAL}[\"']?\s{{0,2}}[:=]"))
    df = df.select(
        "*",
        F.when(F.col("t").rlike(f"[A-Za-z0-9+/_-]{{{LEAST}}}"), F.regexp_extract_all("t", F.lit(LONG), F.lit(0))).otherwise(none).alias("long_m"),
        F.when(assigns, F.regexp_extract_all("t", F.lit(VALUE), F.lit(0))).otherwise(none).alias("value_m"),
    ).where("size(long_m) + size(value_m) > 0")
    df = df.select("*", *[F.when(F.size(f"{k}_m") > 0, F.split("t", pattern, -1)).otherwise(none).alias(f"{k}_p") for k, pattern in (("long", LONG), ("value", VALUE))])
    spans = lambda k: F.expr(
        f"""CASE WHEN size({k}_m) > 0 THEN aggregate(sequence(0, size({k}_m) - 1), named_struct('at', 0, 'out', cast(array() as {SPAN})),
          (a, i) -> named_struct('at', a.at + length({k}_p[i]) + length({k}_m[i]), 'out', concat(a.out, array(named_struct(
            'start', a.at + length({k}_p[i]), 'end', a.at + length({k}_p[i]) + length({k}_m[i]), 'found', {k}_m[i])))), a -> a.out) ELSE cast(array() as {SPAN}) END"""
    )
    df = df.select(*keys, "path", "t", spans("long").alias("runs"), spans("value").alias("values_"))
    every = F.expr("concat(values_, filter(runs, r -> NOT exists(values_, v -> v.start < r.end AND r.start < v.end)))")
    rows = df.select(*keys, "path", "t", F.explode(every).alias("c")).select(*keys, "path", "t", "c.*")
    around = [F.expr(f"substring(t, greatest(start - {WINDOW}, 0) + 1, least(start, {WINDOW}))").alias("before"), F.expr(f"substring(t, end + 1, {WINDOW})").alias("after")]
    rows = rows.select(*keys, "path", "start", "end", "found", *around)
    rows = rows.select("*", F.length("found").cast("double").alias("size"), F.expr("array_distinct(split(found, ''))").alias("chars"), _codes(F.col("found")).alias("codes"))
    share = lambda cls: F.length(F.regexp_replace("found", f"[^{cls}]", "")) / F.col("size")
    flag = lambda column, pattern: F.col(column).rlike(pattern).cast("double")
    table = "array(" + ", ".join(f"{x!r}D" for x in words.transitions) + ")"
    likely = F.expr(f"aggregate(transform(sequence(1, size(codes) - 1), i -> {table}[27 * codes[i - 1] + codes[i]]), 0.0D, (a, x) -> a + x) / (size - 1)")
    uncovered = F.regexp_replace(F.lower("found"), "|".join(sorted(words.frequent, key=len, reverse=True)), "") if words.frequent else F.col("found")
    beside = r"\W{0,6}(?:\w+\W{1,3}){0,2}"
    return rows.select(
        *keys,
        "start",
        "end",
        "found",
        "size",
        F.expr("aggregate(transform(chars, c -> (size - length(replace(found, c, ''))) / size), cast(0 as double), (a, p) -> a - CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END)").alias("entropy"),
        (F.expr(r"regexp_count(found, r'(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])')") / F.col("size")).alias("changes"),
        likely.alias("likely"),
        (F.size("chars") / F.col("size")).alias("kinds"),
        share("0-9").alias("digits"),
        share("A-Z").alias("upper"),
        share("0-9a-fA-F").alias("hex"),
        (1 - share("A-Za-z0-9")).alias("symbols"),
        (1 - F.length(uncovered) / F.col("size")).alias("covered"),
        flag("before", r"[=:]\s*[\"']?$").alias("assigned"),
        flag("before", rf"(?i)(?:{CREDENTIAL}|auth\w*|bearer|key)\W{{0,6}}$").alias("named"),
        flag("before", r"(?i)(commit|sha\d*|md5|hash|checksum|digest|revision|etag|uuid|order|isbn|build|card|see|path)\W{0,6}$").alias("against"),
        flag("before", r"[\"']$").alias("quoted"),
        flag("after", rf"(?i)^{beside}(?:{CREDENTIAL}|key|login)\b").alias("named_after"),
        flag("after", rf"(?i)^{beside}(?:commit|hash|checksum|digest|revision|file|list|page|pages|uuid|item|items|order|characters)\b").alias("against_after"),
        flag("path", r"(?i)\.(env|ya?ml|json|ini|cfg|conf|toml|properties|tf)$|config|secret").alias("config"),
    )


def sample_findings(spark: SparkSession, n: int = FINDINGS, frequent: list[str] | None = None) -> DataFrame:
    """A fixed labelled set (text, source, label): keys as they stand in code and configuration, and what only looks like them.

    Words that stand where a key could are ``frequent`` ones of the corpus, where it has some of 6 letters or more.
    """
    listed = [w for w in frequent or [] if len(w) >= 6 and w.isalpha()] or "window system number please values".split()
    ids = spark.range(n).select("id", F.sha1(F.col("id").cast("string")).alias("h"), F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256).alias("g"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)).alias("u"))
    word = f"element_at(array({', '.join(map(repr, listed))}), cast(pmod(xxhash64(id, 3), {len(listed)}) + 1 as int))"
    real = F.expr(
        """CASE id % 7 WHEN 0 THEN concat('token = "', h, '"') WHEN 1 THEN concat('API_KEY=', regexp_replace(base64(unhex(left(g, 48))), '=', ''))
                WHEN 2 THEN concat('Authorization: Bearer ', regexp_replace(base64(unhex(g)), '=', '')) WHEN 3 THEN concat('password="', left(base64(unhex(h)), 18 + id % 9), '"')
                WHEN 4 THEN concat('secret ghp_', regexp_replace(base64(unhex(left(g, 54))), '[/+=]', 'x')) WHEN 5 THEN concat('pwd: ', left(regexp_replace(base64(unhex(h)), '[/=]', '!'), 7 + id % 6))
                ELSE concat('use ', left(g, 40), ' as the key') END"""
    )
    false = F.expr(
        f"""CASE id % 8 WHEN 0 THEN concat('commit ', h) WHEN 1 THEN concat('uuid ', substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12))
                WHEN 2 THEN concat('the ', right(concat('4', conv(left(g, 14), 16, 10), '0000'), 16), ' and') WHEN 3 THEN concat('sha256:', g)
                WHEN 4 THEN concat('see usr/lib/python3/dist/', {word}, '-', id) WHEN 5 THEN concat('this-is-item-number-', id, '-of-the-list')
                WHEN 6 THEN concat('password: ', {word}, ' it') ELSE concat(h, ' is the commit') END"""
    )
    is_real = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    path = F.when(F.col("u") < F.when(is_real, 60).otherwise(15), F.when(F.col("u") % 2 == 0, "app/config.yml").otherwise("deploy/.env")).otherwise(F.when(F.col("u") % 2 == 0, "src0").otherwise("docs/readme.md"))
    return ids.select(F.concat(F.lit("In the text "), F.when(is_real, real).otherwise(false), F.lit(" it stands.")).alias("text"), path.alias("source"), is_real.cast("int").alias("label"))


def train(findings: DataFrame, words: Words) -> PipelineModel:
    """The forest, on all labelled findings it is given."""
    rows = candidates(findings, ["label"], words).repartition(4, F.xxhash64("found"))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def score(rows: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(rows).withColumn("chance", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scan(df: DataFrame, model: PipelineModel, words: Words, text: str = "text", key: str = "doc_id", source: str | None = "source", cut: float = CUT) -> DataFrame:
    """doc_id, n_candidates, n_secrets and spans (start:end, code points) of every document."""
    mark = F.xxhash64(text)
    own = df.select(F.col(key).cast("long").alias("doc_id"), mark.alias("mark"))
    marked = df.select(F.col(key).cast("long").alias("doc_id"), mark.alias("mark"), F.col(text).alias("text"), (F.col(source) if source else F.lit(None).cast("string")).alias("source"))
    found = score(candidates(marked, ["doc_id", "mark"], words), model).groupBy("doc_id", "mark", "start", "end").agg(F.max("chance").alias("chance"))
    secret = F.col("chance") >= cut
    spans = F.array_sort(F.collect_list(F.when(secret, F.struct("start", "end"))))
    by = found.groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.count(F.when(secret, 1)).alias("s"), F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))
    on = own["doc_id"].eqNullSafe(by["doc_id"]) & own["mark"].eqNullSafe(by["mark"])
    return own.join(by, on, "left").select(own["doc_id"], F.coalesce("n", F.lit(0)).alias("n_candidates"), F.coalesce("s", F.lit(0)).alias("n_secrets"), F.coalesce("spans", F.lit("")).alias("spans"))


def secrets(df: DataFrame, findings: DataFrame | None = None, text: str = "text", key: str = "doc_id", source: str | None = "source") -> DataFrame:
    """The scan of a corpus by a forest that is trained on ``findings`` (the fixed set if none are given) and knows the corpus's words."""
    words = learn_words(df, text)
    return scan(df, train(findings or sample_findings(df.sparkSession, frequent=words.frequent), words), words, text, key, source)
