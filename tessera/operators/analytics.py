"""Relational analytics over the catalogue: time buckets, collections, clusters, neighbour rings, entity memory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X
from tessera.functions import vectors as V


def timeline(rows: DataFrame, ts: str, unit: str, path: str, limit: int = 500) -> DataFrame:
    """(bucket, n, first_ts, last_ts, sample) of the newest ``limit`` (1 to 2000) buckets, oldest first."""
    buckets = rows.where(F.col(ts).isNotNull()).groupBy(X.time_key(F.col(ts), unit).alias("bucket")).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.min(path).alias("sample"))
    return buckets.orderBy(F.desc("bucket")).limit(max(1, min(2000, limit))).orderBy("bucket")


def text_filter(query: str, *columns: str) -> Column:
    """Any column contains the query, whatever the case; % and _ stay wildcards."""
    like = f"%{query.lower()}%"
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).like(like) for c in columns])


def timeline_stats(buckets: DataFrame) -> DataFrame:
    """One row: number of buckets, total, largest, average and the first bucket at the peak."""
    return buckets.agg(F.count("*").alias("buckets"), F.sum("n").cast("long").alias("total"), F.max("n").alias("largest"), F.round(F.avg("n"), 3).alias("average"), F.min_by("bucket", F.struct(-F.col("n"), F.col("bucket"))).alias("peak"))


def collection_filter(query: str, tags: str, ts: str | None, texts: list[str], category: str) -> Column:
    """The query language of saved collections as one condition: all words must hold; unknown keys are ignored."""
    parts = [F.lit(True)]
    for word in query.split():
        key, colon, value = word.partition(":")
        value = value.lower()
        if not colon:
            parts.append(text_filter(word, *texts[:2]))
        elif key == "tag":
            parts.append(F.lower(F.array_join(tags, ",")).contains(value))
        elif key == "date" and ts:
            parts.append(F.date_format(ts, "yyyy-MM-dd HH:mm:ss").startswith(value))
        elif key == "text":
            parts.append(text_filter(value, *texts))
        elif key in ("cat", "category"):
            parts.append(F.lower(category) == value)
    return reduce(lambda a, b: a & b, parts)


def cluster_sizes(clusters: DataFrame, assignments: DataFrame, least: int = 1) -> DataFrame:
    """Clusters with at least ``least`` items (0 lists empty ones too), with the item nearest to the centre."""
    per = assignments.groupBy("cluster_id").agg(F.count("item_id").alias("item_count"), F.min_by("item_id", F.struct("distance", "item_id")).alias("sample"))
    rows = clusters.join(per, clusters["id"] == per["cluster_id"], "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    return rows.where(F.col("item_count") >= least).drop("cluster_id")


def cluster_items(assignments: DataFrame, items: DataFrame, cluster, limit: int = 50) -> DataFrame:
    own = assignments.where(F.col("cluster_id") == cluster)
    return own.join(items, own["item_id"] == items["id"]).orderBy("distance", "id").limit(limit)


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, centroid): the mean vector of each group, position by position."""
    rows = vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def distances(vectors: DataFrame, centres: DataFrame, group: str, vector: str = "embedding", most: int = 10_000) -> DataFrame:
    """Each vector's L2 distance to the centre of its group. Up to ``most`` centres are sent to the vectors; more are joined."""
    few = centres.limit(most + 1).count() <= most
    return vectors.join(F.broadcast(centres) if few else centres, group).withColumn("distance", V.l2(F.col(vector), F.col("centroid")))


def kmeans(vectors: DataFrame, k: int, key: str = "id", vector: str = "embedding", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(id, cluster_id, distance) and (cluster_id, centroid); k is at most the number of vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("embedding")).withColumn("features", array_to_vector("embedding"))
    model = KMeans(k=max(1, min(k, rows.count())), seed=seed, maxIter=30).fit(rows)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, centroid array<double>")
    placed = model.transform(rows).select("id", F.col("prediction").alias("cluster_id"), "embedding")
    return distances(placed, F.broadcast(centres), "cluster_id").select("id", "cluster_id", "distance"), centres


def ring_similarity(vectors: DataFrame, target, k: int, key: str = "id") -> DataFrame:
    """The k nearest vectors of an item, itself apart."""
    own = vectors.where(F.col(key) == target).select(F.col("embedding").alias("own"))
    rows = vectors.where(F.col(key) != target).crossJoin(F.broadcast(own)).select(F.col(key).alias("id"), V.cosine(F.col("embedding"), F.col("own")).alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(k)


def ring_cluster(assignments: DataFrame, target, k: int) -> DataFrame:
    """Other items of an item's cluster, nearest to the centre first."""
    own = assignments.where(F.col("item_id") == target).select("cluster_id")
    return assignments.join(F.broadcast(own), "cluster_id").where(F.col("item_id") != target).orderBy("distance", "item_id").limit(k).select(F.col("item_id").alias("id"), "distance")


def ring_terms(items: DataFrame, target, terms: list[str], ts: str, texts: list[str], k: int, newest: int = 60) -> DataFrame:
    """Of the newest items that hold any term, those with most terms."""
    any_term = reduce(lambda a, b: a | b, [text_filter(t, *texts) for t in terms])
    text = F.lower(F.concat_ws(" ", *texts))
    rows = items.where((F.col("id") != target) & any_term).orderBy(F.desc(ts), "id").limit(newest)
    overlap = reduce(lambda a, b: a + b, [text.contains(t.lower()).cast("long") for t in terms])
    return rows.withColumn("overlap", overlap).where("overlap > 0").orderBy(F.desc("overlap"), "id").limit(k)


def days_between(a: Column, b: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.abs(micros(a) - micros(b)) / 86_400_000_000.0


def ring_time(items: DataFrame, target, ts: str, k: int) -> DataFrame:
    """The k items nearest in time to an item, on either side; ``micros`` is the exact difference, which orders them."""
    own = items.where(F.col("id") == target).select(F.col(ts).alias("own"))
    rows = items.where((F.col("id") != target) & F.col(ts).isNotNull()).crossJoin(F.broadcast(own))
    exact = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("own").cast("timestamp")))
    rows = rows.withColumns({"micros": exact, "days": days_between(F.col(ts), F.col("own"))}).orderBy("micros", "id").limit(k)
    return rows.select("id", F.round("days", 4).alias("days"), F.round(F.col("days") * 24, 2).alias("hours"), "micros")


def nearest_in_time(left: DataFrame, right: DataFrame, by: str, k: int = 1, span: float = 86_400.0) -> DataFrame:
    """For each left row (id, ts) the k right rows (id, ts) of the same ``by`` that are nearest in time: other, days, nth.

    Rights are numbered in order of time, and a left row meets the k numbers before it and the k after it, so nothing is
    compared with all. Numbers are counted within slices of ``span`` seconds, to which the counts of earlier slices are
    added: a hot key is spread over its slices. Equal distances go to the smaller id.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = lambda rows, side: rows.where("ts is not null").select(by, "id", micros.alias("us"), F.floor(micros / (span * 1e6)).alias("slice"), F.lit(side).alias("side"))
    both = cut(left, 0).unionByName(cut(right, 1))
    slices = both.groupBy(by, "slice").agg(F.sum("side").alias("n"))
    earlier = Window.partitionBy(by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(by, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # a left row counts the rights that are earlier than it; rights of one time go by id, upwards and downwards
    own = Window.partitionBy(by, "slice").rowsBetween(Window.unboundedPreceding, 0)
    numbered = both.withColumn("up", F.sum("side").over(own.orderBy("us", "side", "id"))).withColumn("down", F.sum("side").over(own.orderBy("us", "side", F.desc("id"))))
    numbered = numbered.join(slices, [by, "slice"])
    rights = numbered.where("side = 1").select(by, F.col("id").alias("other"), F.col("us").alias("then"), (F.col("before") + F.col("up")).alias("up"), (F.col("before") + F.col("down")).alias("down"))
    lefts = numbered.where("side = 0").select(by, "id", "us", (F.col("before") + F.col("up")).alias("at"))
    after = lefts.withColumn("up", F.explode(F.sequence(F.col("at") + 1, F.col("at") + k))).join(rights.drop("down"), [by, "up"])
    before = lefts.withColumn("down", F.explode(F.sequence(F.col("at") - (k - 1), F.col("at")))).where("down > 0").join(rights.drop("up"), [by, "down"])
    near = after.drop("up").unionByName(before.drop("down")).select(by, "id", "other", (F.abs(F.col("then") - F.col("us")) / 86_400_000_000.0).alias("days"))
    best = near.groupBy(by, "id").agg(F.slice(F.array_sort(F.collect_list(F.struct("days", "other"))), 1, k).alias("m"))  # 2k at most
    return best.select(by, "id", F.posexplode("m").alias("nth", "m")).select(by, "id", F.col("m.other").alias("other"), F.round("m.days", 6).alias("days"), (F.col("nth") + 1).cast("long").alias("nth"))


def first_interval(points: DataFrame, intervals: DataFrame, width: float) -> DataFrame:
    """Each point (key, id, t) with the first interval (key, start, end, seg) of its key that holds it, or none.

    Points and intervals meet by key and time bucket. An interval goes to the level whose buckets (``width`` seconds
    times a power of two) are as long as it is or longer, so it is written to two of them at most; a point looks into
    one bucket of every level there is (the levels are few: one for each doubling).
    """
    length = F.greatest(F.col("end") - F.col("start"), F.lit(width))
    cut = intervals.where(F.col("end") >= F.col("start")).withColumn("level", F.ceil(F.log2(length / width)).cast("int"))
    size = lambda: F.lit(width) * F.pow(F.lit(2.0), F.col("level"))
    cut = cut.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor(F.col("start") / size()), F.floor(F.col("end") / size())))))
    levels = sorted(r[0] for r in cut.select("level").distinct().collect())  # one for each doubling of the width
    if not levels:
        return points.withColumn("seg", F.lit(None).cast(intervals.schema["seg"].dataType)).select("key", "id", "t", "seg")
    asked = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("bucket", F.floor(F.col("t") / size()))
    held = asked.join(cut, ["key", "level", "bucket"]).where(F.col("t").between(F.col("start"), F.col("end")))
    first = held.groupBy("id").agg(F.min_by("seg", F.struct("start", "seg")).alias("seg"))
    return points.join(first, "id", "left").select("key", "id", "t", "seg")


def best_evidence(relations: DataFrame, key: str, confidence: str = "confidence") -> DataFrame:
    """(key, evidence, n): the strongest relation of each item, and how many it has."""
    return relations.groupBy(key).agg(F.max(confidence).alias("evidence"), F.count("*").alias("n"))


def attributes_by_label(entities: DataFrame, attributes: DataFrame) -> DataFrame:
    """Entities (image_id, label) with the attributes (image_id, label, key, value, confidence) that name their label.

    Labels, keys and values are compared and kept trimmed and in lower case; attributes without one of them go.
    """
    low = lambda c: F.lower(F.trim(c))
    rows = attributes.select("image_id", low("label").alias("label"), low("key").alias("key"), low("value").alias("value"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    rows = rows.where("label <> '' and key <> '' and value <> ''")
    by = rows.groupBy("image_id", "label").agg(F.array_sort(F.collect_list(F.struct("key", "value", "confidence"))).alias("attributes"))
    own = entities.withColumn("label", low("label")).where("label <> ''")
    return own.join(by, ["image_id", "label"], "left").withColumn("attributes", F.coalesce("attributes", F.expr("cast(array() as array<struct<key:string,value:string,confidence:double>>)")))


def attribute_map(attributes: DataFrame, highest: bool = False) -> DataFrame:
    """(image_id, attributes): one value a key; of least confidence, unless ``highest``."""
    order = F.struct(-F.col("confidence") if highest else F.col("confidence"), F.col("value"))
    one = attributes.groupBy("image_id", "key").agg(F.min_by("value", order).alias("value"))
    return one.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))


def relations_resolved(relations: DataFrame, entities: DataFrame, parts: int | None = None) -> DataFrame:
    """Relations with the entity ids of their subject and object labels; the first entity of a label wins.

    ``parts`` is the number of partitions of either side of the joins; None leaves it to the session.
    """
    spread = lambda rows, *keys: rows.repartition(parts, *keys) if parts else rows
    labelled = spread(entities.select("image_id", F.lower("label").alias("label"), "entity_id"), "image_id", "label")
    first = labelled.groupBy("image_id", "label").agg(F.min("entity_id").alias("entity_id"))
    s = first.select("image_id", F.col("label").alias("s"), F.col("entity_id").alias("subject_id"))
    o = first.select("image_id", F.col("label").alias("o"), F.col("entity_id").alias("object_id"))
    rows = relations.withColumn("s", F.lower("subject")).withColumn("o", F.lower("object"))
    named = spread(rows, "image_id", "s").join(s, ["image_id", "s"], "left")
    return spread(named, "image_id", "o").join(o, ["image_id", "o"], "left").drop("s", "o")


def entity_memory(images: DataFrame, entities: DataFrame, attributes: DataFrame, mentions: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Each image with its entities (most certain first), attribute map, mentions and, if given, relations (most certain first)."""
    first = lambda rows, name, *fields: rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), *fields))).alias(name))
    e = first(entities, "entities", "label").withColumn("entities", F.transform("entities", lambda x: x["label"]))
    m = mentions.groupBy("image_id").agg(F.array_sort(F.collect_set("mention")).alias("mentions"))
    out = images.join(e, "image_id", "left").join(attribute_map(attributes), "image_id", "left").join(m, "image_id", "left")
    if relations is None:
        return out
    r = first(relations, "relations", "subject", "relation", "object").withColumn("relations", F.transform("relations", lambda x: F.struct(x["subject"].alias("subject"), x["relation"].alias("relation"), x["object"].alias("object"), (-x["c"]).alias("confidence"))))
    return out.join(r, "image_id", "left")


def page(rows: DataFrame, limit: int, offset: int = 0, *order: Column) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def topic_bias(activity: DataFrame, last: int = 10, least: int = 3) -> DataFrame:
    """(user_id, category, n, bias): categories seen at least ``least`` times in a user's last activities."""
    recent = activity.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("rn") <= last)
    counts = recent.groupBy("user_id", "category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("user_id"))
    return counts.withColumn("bias", 1 + 0.5 * F.col("n") / total).where(F.col("n") >= least)


def routing_adjust(bias: DataFrame, textual: list[str], visual: list[str]) -> DataFrame:
    """(user_id, adjust): +0.15 towards text, -0.10 towards images, or 0, by the categories a user leans to."""
    by = bias.groupBy("user_id").agg(F.bool_or(F.col("category").isin(textual)).alias("t"), F.bool_or(F.col("category").isin(visual)).alias("v"))
    return by.select("user_id", F.when(F.col("t"), 0.15).when(F.col("v"), -0.10).otherwise(0.0).alias("adjust"))
