"""Chunk graph and entity graph: projections, neighbour expansion, personalised PageRank, chunk scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators.ranks import BLOCK, Graph

NEXT_WEIGHT, PREVIOUS_WEIGHT, SEEDS = 0.75, 0.70, 20


def projection(chunks: DataFrame, next_edges: DataFrame, mentions: DataFrame, triples: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(src, dst, rel, weight): all edge kinds in one view."""
    one = lambda d, a, b, rel, w: d.select(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"), F.lit(rel).alias("rel"), w.cast("double").alias("weight"))
    docs = chunks.select("document_id", "dataset_id").distinct()
    parts = [one(docs, "document_id", "dataset_id", "IN_DATASET", F.lit(1.0)), one(chunks, "document_id", "chunk_id", "HAS_CHUNK", F.lit(1.0)), one(next_edges, "src", "dst", "NEXT", F.lit(1.0)), one(mentions, "chunk_id", "entity_id", "MENTIONS", F.col("count")), one(triples, "subj_id", "obj_id", "RELATION", F.col("confidence")), one(synonyms, "a_id", "b_id", "SYNONYM", F.col("score"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("edges"))


def expand(seeds: DataFrame, next_edges: DataFrame, top_k: int = 200, most_seeds: int = SEEDS) -> DataFrame:
    """(chunk_id, score, rank): seeds (chunk_id, rank) at 1 / rank, chunks after them at 0.75 / rank, before at 0.7 / rank, the highest of each.

    The seeds are at most most_seeds rows, so they are broadcast to the edges.
    """
    s = seeds.where(F.col("rank") <= most_seeds).select(F.col("chunk_id").alias("seed"), (1.0 / F.col("rank")).alias("w"))
    few = F.broadcast(s)
    after = next_edges.join(few, next_edges.src == s.seed).select(F.col("dst").alias("chunk_id"), (F.col("w") * NEXT_WEIGHT).alias("w"))
    before = next_edges.join(few, next_edges.dst == s.seed).select(F.col("src").alias("chunk_id"), (F.col("w") * PREVIOUS_WEIGHT).alias("w"))
    scored = s.select(F.col("seed").alias("chunk_id"), "w").unionByName(after).unionByName(before).groupBy("chunk_id").agg(F.round(F.max("w"), 6).alias("score"))
    top = scored.orderBy(F.desc("score"), "chunk_id").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


def expand_by_position(hits: DataFrame, chunks: DataFrame, top_k: int = 200, most_seeds: int = SEEDS) -> DataFrame:
    """`expand` without an edge table: neighbours are the chunks before and after in the document, found by their ids, `document:position`.

    At most three ids a seed, so a bounded table, are broadcast to one scan of the chunks' ids.
    """
    s = hits.where(F.col("rank") <= most_seeds).select(F.expr("substring_index(chunk_id, ':', -1)").cast("int").alias("p"), F.expr("left(chunk_id, length(chunk_id) - length(substring_index(chunk_id, ':', -1)))").alias("d"), (1.0 / F.col("rank")).alias("w"))
    near = s.select(F.explode(F.array(*[F.struct(F.concat("d", (F.col("p") + k).cast("string")).alias("chunk_id"), (F.col("w") * w).alias("w")) for k, w in ((0, 1.0), (1, NEXT_WEIGHT), (-1, PREVIOUS_WEIGHT))])).alias("x")).select("x.*")
    scored = chunks.select("chunk_id").join(F.broadcast(near), "chunk_id").groupBy("chunk_id").agg(F.round(F.max("w"), 6).alias("score"))
    top = scored.orderBy(F.desc("score"), "chunk_id").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


def reached(edges: DataFrame, steps: list[tuple[str, str]], start: DataFrame | None = None, end: DataFrame | None = None) -> DataFrame:
    """(src, dst, paths, weight): the pairs of nodes that a pattern of hops links, how many paths do, and the sum of their weights' products.

    steps: (relation, "out" or "in") for each hop over edges (src, dst, rel, weight), from start to end, tables of node ids (id) or None for
    any. A hop is a join on the node reached, summed by pair at once, so what goes on are pairs, never single paths; nodes that start no
    path go before the first join and the last hop keeps only targets. A hub is a skewed join key, which adaptive execution splits. Null ends link nothing;
    parallel edges are paths of their own; a path may come back to its start.
    """
    if not steps or any(way not in ("out", "in") for _, way in steps):
        raise ValueError("steps are (relation, 'out' or 'in')")
    found = None
    for k, (rel, way) in enumerate(steps):
        a, b = ("src", "dst") if way == "out" else ("dst", "src")
        hop = edges.where((F.col("rel") == rel) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col(a).alias("at"), F.col(b).alias("to"), F.coalesce("weight", F.lit(0.0)).alias("w"))
        if k == 0 and start is not None:
            hop = hop.join(start.select(F.col("id").alias("at")).distinct(), "at", "left_semi")
        if k == len(steps) - 1 and end is not None:
            hop = hop.join(end.select(F.col("id").alias("to")).distinct(), "to", "left_semi")
        if found is None:
            moved = hop.select(F.col("at").alias("src"), F.col("to").alias("dst"), F.lit(1).cast("long").alias("paths"), F.col("w").alias("weight"))
        else:
            moved = found.withColumnRenamed("dst", "at").join(hop, "at").select("src", F.col("to").alias("dst"), "paths", (F.col("weight") * F.col("w")).alias("weight"))
        found = moved.groupBy("src", "dst").agg(F.sum("paths").alias("paths"), F.sum("weight").alias("weight"))
    return found


def transition(triples: DataFrame, synonyms: DataFrame, mentions: DataFrame) -> DataFrame:
    """(src, dst, weight): relations both ways by confidence (0 counts as 1), synonyms as stored, mentions both ways by
    log(1 + count); no self loops, doubles summed, rows sum to 1. Passage nodes are `passage:` + chunk id.

    Edges are shuffled once, by their source: pairs and a node's sum are made where its edges lie, so a hub's are sorted, on disk if they must be, by one task."""
    conf = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))
    rel = triples.select(F.col("subj_id").alias("a"), F.col("obj_id").alias("b"), conf.alias("w"))
    men = mentions.select(F.concat(F.lit("passage:"), "chunk_id").alias("a"), F.col("entity_id").alias("b"), F.log1p(F.when(F.col("count") == 0, 1).otherwise(F.col("count"))).alias("w"))
    both = rel.unionByName(men).select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))).alias("x")).select("x.*")
    edges = both.unionByName(synonyms.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.col("score").alias("w"))).where("src <> dst")
    summed = edges.repartition("src").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return summed.withColumn("d", F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", F.when(F.col("d") == 0, 0.0).otherwise(F.col("w") / F.col("d")).alias("weight"))


def _kept(df: DataFrame) -> DataFrame:
    """df as a table in the checkpoint folder, read by every step."""
    import uuid

    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, iterations: int = 50, tolerance: float = 1e-6, hub: int | None = None) -> DataFrame:
    """(node, score) of positive mass: r = (1 - alpha) s + alpha M' r from r = s.

    Seeds (node, weight) outside the graph or not positive are dropped, the rest normalised; without edges r stays s.
    The edges are made arrays of numbers in files once (`ranks.Graph`, about so many a block as hub says), so a step sorts, shuffles and compares no rows: a task for each
    block of nodes adds up what its edges bring. tolerance 0 runs all iterations whatever the change.
    """
    edges = edges.select("src", "dst", "weight")
    total = seeds.where("weight > 0")
    share = lambda live: _kept(live.crossJoin(F.broadcast(live.agg(F.sum("weight").alias("t")))).select("node", (F.col("weight") / F.col("t")).alias("s")))
    total = total.groupBy("node").agg(F.sum("weight").alias("weight"))
    if edges.isEmpty():
        return share(total).select("node", F.col("s").alias("score"))
    g = Graph(edges, edges.sparkSession.sparkContext.getCheckpointDir(), hub or BLOCK)
    # seeds are few: the nodes are looked through for them
    s = share(g.nodes.join(F.broadcast(total), "node").select("node", "weight"))
    g.start(s, "s")
    old = "s"
    for k in range(iterations):
        new = f"r{k}"
        change = g.step(old, new, "s", alpha)
        if old != "s":
            g.forget(old)
        old = new
        if tolerance and change < tolerance:
            break
    g.forget("edges", "index", "hash")
    return g.ranks(old)


def chunk_scores(ranks: DataFrame, mentions: DataFrame, chunks: DataFrame, datasets: list[str] | None = None, top: int = 12) -> DataFrame:
    """(chunk_id, score, passage_score, entity_score, entities): passage mass plus entity mass times log(1 + mentions), positive only. All entities with mass take part."""
    passage = ranks.where("node like 'passage:%' and score > 0").select(F.expr("substring(node, 9)").alias("chunk_id"), F.col("score").alias("p"), F.lit(0.0).alias("e"), F.lit(None).cast("string").alias("entity_id"))
    with_mass = ranks.where("not node like 'passage:%' and score > 0")
    entity = mentions.join(with_mass, mentions.entity_id == with_mass.node).select("chunk_id", F.lit(0.0).alias("p"), (F.col("score") * F.log1p(F.when(F.col("count") == 0, 1).otherwise(F.col("count")))).alias("e"), "entity_id")
    allowed = chunks.select("chunk_id") if datasets is None else chunks.where(F.col("dataset_id").isin(*datasets)).select("chunk_id")
    one = passage.unionByName(entity).join(allowed, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.sum("p").alias("p"), F.sum("e").alias("e"), F.array_sort(F.collect_set("entity_id")).alias("entities"))
    return one.select("chunk_id", F.round(F.col("p") + F.col("e"), 6).alias("score"), F.round("p", 6).alias("passage_score"), F.round("e", 6).alias("entity_score"), F.concat_ws(",", "entities").alias("entities")).where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(top)


def read_only(statement: str, limit: int = 200, spark=None) -> str:
    """The statement with a LIMIT if its outermost part has none. Spark's own parser reads it, and every node of the plan, subqueries too, must be a plain relational operator: commands, writes and scripts are refused, wherever they stand."""
    from pyspark.errors import ParseException
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.active()
    body = statement.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except ParseException as e:
        raise ValueError("not a statement that can be read") from e
    todo, names = [plan], []
    while todo:
        p = todo.pop()
        names.append(p.nodeName())
        for kids in (p.children(), p.innerChildren(), p.subqueriesAll()):
            todo += [k for k in (kids.apply(i) for i in range(kids.length())) if "logical" in k.getClass().getName()]
    for n in names:
        if n not in _READS:
            raise ValueError(f"not a read: {n}")
    if names[0] == "GlobalLimit":
        return body
    return f"SELECT * FROM ({body}\n) LIMIT {int(limit)}" if "--" in body or "/*" in body else f"{body} LIMIT {int(limit)}"


# Nodes of parsed statements that only read.
_READS = frozenset("GlobalLimit LocalLimit Offset Project Filter Aggregate Sort Distinct Join Union Intersect Except SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedHaving LocalRelation OneRowRelation UnresolvedInlineTable Generate LateralJoin WithWindowDefinition Window Pivot Unpivot Sample UnresolvedTableValuedFunction UnresolvedHint RelationTimeTravel ResolvedHint".split())


def ask(spark, statement: str, views: dict[str, DataFrame], limit: int = 200) -> DataFrame:
    """Run a read-only SQL statement over node and edge views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(read_only(statement, limit, spark))
