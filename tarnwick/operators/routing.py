"""Routing summaries of document folders: profiles, rooms, wings and links between rooms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import chunking


def _top(items: DataFrame, group: list[str], value: str, weight: str, first: str, most: int, out: str) -> DataFrame:
    """The most frequent values of each group as an array, ties by first appearance; at most `most` values are gathered."""
    w = Window.partitionBy(*group).orderBy(F.desc("__c"), "__p", value)
    best = items.groupBy(*group, value).agg(F.sum(weight).alias("__c"), F.min(first).alias("__p")).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    return best.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", value))), lambda x: x[value]).alias(out))


def _topic_words(content: Column, headings: Column) -> Column:
    """Topic words of a document, those of headings first and three times each."""
    head = F.flatten(F.transform(headings, T.topic_words))
    return F.concat(F.flatten(F.transform(head, lambda w: F.array_repeat(w, 3))), T.topic_words(content))


def topics(docs: DataFrame, most: int = 8) -> DataFrame:
    """(path, about): most frequent topic words, those of headings counting three times and coming first in ties. A document is counted in its row; nothing is shuffled."""
    rows = docs.select("path", "content", T.headings(F.col("content")).alias("headings"))
    return rows.select("path", T.most_frequent(_topic_words(F.col("content"), F.col("headings")), most).alias("about")).where("size(about) > 0")


def acronym_list(docs: DataFrame, most: int = 8) -> DataFrame:
    """(path, entities): capital words seen twice or more, most frequent first."""
    return docs.select("path", T.most_frequent(T.acronyms(F.col("content")), most, 2).alias("entities")).where("size(entities) > 0")


_BONUS = (("decisions", r"(?:^|[^\p{L}\p{N}_])decision|trade-?off|chosen(?:$|[^\p{L}\p{N}_])"), ("problems", r"(?:^|[^\p{L}\p{N}_])error|troubleshoot|debug|incident(?:$|[^\p{L}\p{N}_])"), ("reference", r"(?:^|[^\p{L}\p{N}_])reference|matrix|lookup(?:$|[^\p{L}\p{N}_])"))
_LATE = 1 << 40


def _bonus(headings: Column) -> Column:
    """Classes (hall, p, n) that a document's headings speak for."""
    heads = F.lower(F.array_join(headings, " "))
    found = [F.when(heads.rlike(body), F.struct(F.lit(hall).alias("hall"), F.lit(_LATE + k).alias("p"), F.lit(2).alias("n"))) for k, (hall, body) in enumerate(_BONUS)]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def dominant_class(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, dominant_hall): class of most chunks (document_id is the path), heading words adding two; ties by first appearance; `reference` without chunks."""
    c = chunks.select(F.col("document_id").alias("path"), T.chunk_class(F.col("content")).alias("hall"), F.col("position").cast("long").alias("p"), F.lit(1).alias("n"))
    extra = docs.select("path", F.explode(_bonus(T.headings(F.col("content")))).alias("x")).select("path", "x.hall", "x.p", "x.n")
    score = c.unionByName(extra).groupBy("path", "hall").agg(F.sum("n").alias("n"), F.min("p").alias("p"))
    best = score.groupBy("path").agg(F.max_by("hall", F.struct("n", -F.col("p"))).alias("dominant_hall"))
    return docs.select("path").join(best, "path", "left").select("path", F.coalesce("dominant_hall", F.lit("reference")).alias("dominant_hall"))


def _dominant(halls: Column, bonus: Column) -> Column:
    """`dominant_class` of the classes of a document's chunks, in order, and what its headings speak for."""
    last = F.lit(2 * _LATE)

    def score(hall: str) -> Column:
        own = F.filter(bonus, lambda x: x["hall"] == hall)
        first = F.when(F.array_contains(halls, hall), F.array_position(halls, F.lit(hall)) - 1).otherwise(F.coalesce(F.get(own, 0)["p"], last))
        return F.struct((F.size(F.filter(halls, lambda x: x == hall)) + 2 * F.size(own)).alias("n"), (-first).alias("p"), F.lit(hall).alias("hall"))

    best = F.array_max(F.array(*[score(hall) for hall in T.CLASS_ORDER]))
    return F.transform(F.array(best), lambda x: F.when(x["n"] > 0, x["hall"]).otherwise("reference"))[0]


def sections(headings: Column, about: Column) -> Column:
    """Up to six sections of the headings with keywords, or core / details / exceptions out of the topics."""
    words = lambda h: F.slice(T.topic_words(h), 1, 3)
    made = F.transform(F.slice(headings, 1, 6), lambda h, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("id"), F.substring(h, 1, 80).alias("label"), F.when(F.size(words(h)) > 0, words(h)).otherwise(F.slice(about, 1, 3)).alias("keywords")))
    n = F.least(F.lit(3), F.floor(F.size(about) / 2).cast("int") + 1)
    spare = F.transform(F.slice(F.array(*[F.lit(x) for x in ("core", "details", "exceptions")]), F.lit(1), n), lambda x, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("id"), x.alias("label"), F.slice(about, i * 2 + 1, F.lit(3)).alias("keywords")))
    return F.when(F.size(headings) > 0, made).otherwise(spare)


def profiles(docs: DataFrame, root: str = "root") -> DataFrame:
    """One row per document (path, content): wing, room, class, topics, question types, entities, sections.

    All of a document is found in its row, in one pass over the texts without joins or shuffles, so the work grows as the texts do."""
    text = F.col("content")
    rows = docs.select("path", "content", T.headings(text).alias("headings"), T.question_types(text).alias("qtypes"))
    found = rows.select("path", "headings", "qtypes", chunking.lines(text).alias("chunks"), T.most_frequent(_topic_words(text, F.col("headings")), 8).alias("topics"), T.most_frequent(T.acronyms(text), 6, 2).alias("entities"))
    classed = found.select("path", "headings", "qtypes", "topics", "entities", F.transform("chunks", T.chunk_class).alias("halls"), _bonus(F.col("headings")).alias("bonus"))
    path, topic = F.col("path"), F.col("topics")
    return classed.select("path", T.wing(path, root).alias("wing"), T.room(path).alias("room"), "headings", "qtypes", _dominant(F.col("halls"), F.col("bonus")).alias("dominant_hall"), F.size("halls").cast("long").alias("chunk_count"), F.slice(topic, 1, 6).alias("about"), "entities", sections(F.col("headings"), topic).alias("sections"))


def rooms(profile: DataFrame) -> DataFrame:
    """One row per (wing, room): documents, main class, top topics, entities and question types, and a rank. Documents count in path order."""
    key = ["wing", "room"]
    ordered = profile.withColumn("__o", F.dense_rank().over(Window.partitionBy(*key).orderBy("path")).cast("long") * 1000)
    out = ordered.groupBy(*key).agg(F.count("*").alias("doc_count"))
    for col, most in (("about", 6), ("entities", 6), ("qtypes", 5)):
        rows = ordered.select(*key, "__o", F.posexplode(col).alias("p", "token")).select(*key, (F.col("__o") + F.col("p")).alias("p"), "token", F.lit(1).alias("n"))
        out = out.join(_top(rows, key, "token", "n", "p", most, col), key, "left")
    hall = ordered.groupBy(*key, "dominant_hall").agg(F.count("*").alias("n"), F.min("__o").alias("p")).groupBy(*key).agg(F.max_by("dominant_hall", F.struct("n", -F.col("p"))).alias("dominant_hall"))
    none = F.array().cast("array<string>")
    out = out.join(hall, key).withColumns({c: F.coalesce(c, none) for c in ("about", "entities", "qtypes")})
    rank = F.col("doc_count") * 10 + F.size("about") * 3 + F.size("qtypes") * 2 + F.size("entities")
    return out.withColumn("room_rank", rank.cast("long"))


def room_sections(profile: DataFrame, most: int = 8) -> DataFrame:
    """(wing, room, id, label): sections of a room's documents in order, labels once (letters' case and white space aside), renumbered."""
    key = ["wing", "room"]
    rows = profile.select(*key, "path", F.posexplode("sections").alias("p", "s")).withColumn("norm", F.regexp_replace(F.lower(F.trim("s.label")), r"\s+", " ")).where("norm <> ''")
    first = rows.groupBy(*key, "norm").agg(F.min(F.struct("path", "p", F.col("s.label").alias("label"))).alias("f"))
    k = F.row_number().over(Window.partitionBy(*key).orderBy("f.path", "f.p"))
    return first.withColumn("k", k).where(F.col("k") <= most).select(*key, F.concat(F.lit("S"), F.col("k").cast("string")).alias("id"), F.substring("f.label", 1, 80).alias("label"))


def _class_order(c: Column) -> Column:
    out = F.lit(99)
    for name, k in T.CLASS_ORDER.items():
        out = F.when(c == name, k).otherwise(out)
    return out


def room_order(room: DataFrame) -> DataFrame:
    """Rooms with their place in their wing: class order, higher rank, name."""
    w = Window.partitionBy("wing").orderBy(_class_order(F.col("dominant_hall")), F.desc("room_rank"), "room")
    return room.withColumn("place", F.row_number().over(w))


def wings(room: DataFrame) -> DataFrame:
    """One row per wing: room order, class counts and a summary of two topics and a question type."""
    placed = room_order(room)
    key = ["wing"]
    base = placed.groupBy("wing").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("place", "room"))), lambda x: x["room"])).alias("room_order"))
    halls = placed.groupBy("wing", "dominant_hall").agg(F.count("*").alias("n")).groupBy("wing").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "dominant_hall", "n")))).alias("hall_counts"))
    rows = lambda col, n: placed.select("wing", "place", F.posexplode(F.slice(col, 1, n)).alias("p", "token")).select("wing", (F.col("place").cast("long") * 1000 + F.col("p")).alias("p"), "token", F.lit(1).alias("n"))
    out = base.join(halls, key).join(_top(rows("about", 3), key, "token", "n", "p", 2, "t"), key, "left").join(_top(rows("qtypes", 2), key, "token", "n", "p", 1, "q"), key, "left")
    summary = F.concat_ws(", ", F.col("t"), F.col("q"))
    return out.select("wing", F.when(summary == "", "general documentation").otherwise(summary).alias("summary"), "room_order", "hall_counts")


def not_topics(room: DataFrame, most: int = 6) -> DataFrame:
    """(wing, room, not_about): topics of the two most similar rooms of the wing that the room lacks, in order.

    Rooms of a wing are compared where they share a topic, an equi-join on (wing, topic)."""
    t = room.select("wing", "room", F.explode("about").alias("token"))
    o = t.select("wing", F.col("room").alias("other"), "token")
    overlap = t.join(o, ["wing", "token"]).where("room <> other").groupBy("wing", "room", "other").agg(F.count("*").alias("n"))
    near = overlap.withColumn("k", F.row_number().over(Window.partitionBy("wing", "room").orderBy(F.desc("n"), "other"))).where("k <= 2")
    theirs = room.select("wing", F.col("room").alias("other"), F.posexplode("about").alias("p", "token"))
    new = near.join(theirs, ["wing", "other"]).select("wing", "room", "k", "p", "token").join(t, ["wing", "room", "token"], "left_anti").groupBy("wing", "room", "token").agg(F.min(F.struct("k", "p")).alias("at"))
    best = new.withColumn("i", F.row_number().over(Window.partitionBy("wing", "room").orderBy("at"))).where(F.col("i") <= most)
    return best.groupBy("wing", "room").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"])).alias("not_about"))


def tunnels(room: DataFrame, most: int = 40) -> DataFrame:
    """(room_a, room_b, label): pairs of rooms that share an entity, else a question type, else two topics, labelled with the first shared one.

    Pairs come from equi-joins on the shared value, so rooms without anything in common never meet."""
    order = F.struct("wing", _class_order(F.col("dominant_hall")).alias("h"), (-F.col("room_rank")).alias("r"), "room")
    base = room.withColumn("ord", order)
    rows = None
    for kind, col in (("a_entity", "entities"), ("b_qtype", "qtypes"), ("c_topic", "about")):
        one = base.select("ord", F.col("room").alias("name"), F.lit(kind).alias("kind"), F.explode(col).alias("token"))
        rows = one if rows is None else rows.unionByName(one)
    a = rows.select(F.col("ord").alias("oa"), F.col("name").alias("room_a"), "kind", "token")
    b = rows.select(F.col("ord").alias("ob"), F.col("name").alias("room_b"), "kind", "token")
    shared = a.join(b, ["kind", "token"]).where("oa < ob").groupBy("oa", "ob", "room_a", "room_b", "kind").agg(F.min("token").alias("token"), F.count("*").alias("n")).where("kind <> 'c_topic' or n >= 2")
    best = shared.groupBy("oa", "ob", "room_a", "room_b").agg(F.min(F.struct("kind", "token")).alias("x"))
    label = F.concat(F.when(F.col("x.kind") == "a_entity", "shared_entity:").when(F.col("x.kind") == "b_qtype", "shared_qtype:").otherwise("shared_topic:"), F.col("x.token"))
    return best.select("room_a", "room_b", label.alias("label")).orderBy("label", "room_a", "room_b").limit(most)


def shared_rooms(docs: DataFrame) -> DataFrame:
    """(room, wings): rooms found in two wings or more."""
    return docs.groupBy("room").agg(F.array_sort(F.collect_set("wing")).alias("w")).where("size(w) >= 2").select("room", F.concat_ws(",", "w").alias("wings"))


def scan_stats(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("new", "changed", "removed")])
