"""Knowledge graphs: merging, community nodes, entity context and assembled contexts.

nodes (id, kind, name, type, description, sources array<string>), one row for each id; edges (src, dst, kind, label), one row for each pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import SETTINGS
from corvane.operators.numbering import gapless, running
from corvane.sources.scratch import saved

#: Kinds of nodes and edges, and the prefix of community ids.
ENTITY, COMMUNITY, MENTIONS, BELONGS, COMMUNITY_ID = "entity", "community", "menciona", "pertenece_a", "com:"
#: Fixed value: characters of an earlier subtask's results that go into a context.
RESULT_CHARS = 3000
#: Fixed value: what stands between two blocks of a context.
GAP = "\n\n"


def merge_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """The nodes of both, by id.

    A node that both have is that of ``a``; of an entity the sources are those of both, sorted, and the description is the
    longer one, of equals that of ``a``.  So merging a graph with itself changes nothing but the order of sources, and of three
    graphs any two can be merged first.
    """
    x, y = a.withColumn("_a", F.lit(True)).alias("x"), b.withColumn("_b", F.lit(True)).alias("y")
    both = x.join(y, F.col("x.id") == F.col("y.id"), "full_outer")
    has, also = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    fused = has & also & (F.col("x.kind") == ENTITY)
    pick: dict[str, Column] = {c: F.when(has, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")) for c in a.columns}
    none = F.array().cast("array<string>")
    sources = F.array_sort(F.array_union(F.coalesce("x.sources", none), F.coalesce("y.sources", none)))
    longer = F.length(F.coalesce("y.description", F.lit(""))) > F.length(F.coalesce("x.description", F.lit("")))
    pick["sources"] = F.when(fused, sources).otherwise(pick["sources"])
    pick["description"] = F.when(fused & longer, F.col("y.description")).otherwise(pick["description"])
    return both.select(*[v.alias(c) for c, v in pick.items()])


def merge_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """The edges of ``a``, and those of ``b`` between two nodes that no edge of ``a`` joins that way."""
    return a.unionByName(b.join(a.select("src", "dst"), ["src", "dst"], "left_anti").select(*a.columns))


def merge(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of two graphs in one."""
    return merge_nodes(a[0], b[0]), merge_edges(a[1], b[1])


def community_key(found: DataFrame) -> DataFrame:
    """community, key: a name that depends on the members alone, by which a summary is found again.

    Members are hashed and added up, so no task holds those of a community.
    """
    h = F.conv(F.substring(F.md5(F.col("node").cast("string").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = found.groupBy("community").agg(F.sum(h).alias("h"), F.count(F.lit(1)).alias("n"))
    return sums.select("community", F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("h").cast("string")), 256), 1, 16).alias("key"))


def with_communities(nodes: DataFrame, edges: DataFrame, found: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with a node for each community of ``found`` (node, community, size) and an edge to it from each member.

    summaries (key, summary); a community without one has an empty summary.  Community nodes are numbered from 0.
    """
    named = saved(found.groupBy("community").agg(F.first("size").alias("size")).join(community_key(found), "community"), "communities")
    numbered = gapless(named, [], ["community"], "n").join(summaries.dropDuplicates(["key"]), "key", "left")
    numbered = saved(numbered.withColumn("id", F.concat(F.lit(COMMUNITY_ID), F.col("n").cast("string"))), "communities")
    empty = F.lit(None).cast("string")
    new = numbered.select("id", F.lit(COMMUNITY).alias("kind"), empty.alias("name"), empty.alias("type"), F.coalesce("summary", F.lit("")).alias("description"), F.array().cast("array<string>").alias("sources"))
    joins = found.join(numbered.select("community", "id"), "community").select(F.col("node").cast("string").alias("src"), F.col("id").alias("dst"), F.lit(BELONGS).alias("kind"), empty.alias("label"))
    return nodes.unionByName(new.select(*nodes.columns)), edges.unionByName(joins.select(*edges.columns))


def ranked_entities(mentioned: DataFrame, relations: DataFrame, cap: int = SETTINGS.entity_cap) -> DataFrame:
    """section, entity, place: what each section mentions, in order, then what is one relation away, at most ``cap``.

    mentioned (section, entity, seq); relations (src, dst, seq).  The neighbours of the first mentioned entity come first, those it
    points to before those that point to it, each in the order of the relations; an entity keeps its first place.
    """
    own = mentioned.groupBy("section", "entity").agg(F.min("seq").alias("seq"))
    sides = relations.select(F.col("src").alias("entity"), F.col("dst").alias("other"), F.lit(0).alias("side"), F.col("seq").alias("n"))
    sides = sides.unionByName(relations.select(F.col("dst").alias("entity"), F.col("src").alias("other"), F.lit(1).alias("side"), F.col("seq").alias("n")))
    near = own.join(sides, "entity").select("section", F.col("other").alias("entity"), F.lit(1).alias("far"), "seq", "side", "n")
    every = own.select("section", "entity", F.lit(0).alias("far"), "seq", F.lit(0).alias("side"), F.lit(0).cast("long").alias("n")).unionByName(near.withColumn("n", F.col("n").cast("long")))
    first = every.groupBy("section", "entity").agg(F.min(F.struct("far", "seq", "side", "n")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("at", "entity"))).filter(F.col("place") <= cap).select("section", "entity", "place")


def context_communities(chosen: DataFrame, edges: DataFrame) -> DataFrame:
    """section, community, place: the communities of the chosen entities, in the order of their ids as strings."""
    of = edges.filter(F.col("kind") == BELONGS).select(F.col("src").alias("entity"), F.col("dst").alias("community"))
    found = chosen.select("section", F.col("entity").cast("string").alias("entity")).join(of, "entity").select("section", "community").distinct()
    return found.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("community")))


def shared_entities(mentions: DataFrame) -> DataFrame:
    """section, mentioned, shared: how many entities each section mentions, and how many of these other sources mention too.

    mentions (section, source, entity).
    """
    sources = mentions.groupBy("entity").agg(F.min("source").alias("a"), F.max("source").alias("b"))
    own = mentions.select("section", "entity").distinct().join(sources, "entity")
    return own.groupBy("section").agg(F.count(F.lit(1)).alias("mentioned"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("shared"))


#: Streams of a context in their order.
STREAMS = ("closure", "entities", "communities", "similar", "results")


def cited(cite: Column, role: Column, text: Column) -> Column:
    return F.concat(F.lit("["), cite, F.lit("] ("), role, F.lit(")\n"), text)


def entity_lines(entities: DataFrame) -> DataFrame:
    """subject, text: the block of a subject's entities (subject, place, name, type, sources, description), at most a capped number."""
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit("; "), F.array_join("sources", ", "), F.lit("): "), "description")
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return entities.groupBy("subject").agg(lines.alias("l")).select("subject", F.concat(F.lit("[knowledge graph · entities]\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def assemble(streams: dict[str, DataFrame], budget: int) -> DataFrame:
    """subject, position, stream, role, citation, text, before: the blocks of each subject's context, as far as ``budget`` characters reach.

    Each stream is (subject, place long, role, citation, text); streams stand in the order of STREAMS, blocks in the order of place.
    ``before`` counts the characters of all earlier blocks with the gaps after them; a block is kept if it ends within the
    budget and so do all before it.  Sums are taken by stretches of places, so a subject of any number of blocks is in no one task.
    """
    rows = [df.select("subject", F.lit(STREAMS.index(name)).alias("stream"), F.col("place").cast("long").alias("place"), "role", "citation", "text") for name, df in streams.items()]
    every = saved(reduce(DataFrame.unionByName, rows).withColumn("size", F.length("text") + len(GAP)), "blocks")
    sums = running(every, ["subject"], ["stream", "place"], "place", "size", "before")
    kept = sums.filter(F.col("before") + F.length("text") <= budget)  # sums only grow, so what follows a block that does not fit starts beyond it or is shorter
    late = sums.filter(F.col("before") + F.length("text") > budget).groupBy("subject").agg(F.min("before").alias("cut"))
    kept = kept.join(late, "subject", "left").filter("cut IS NULL OR before < cut")
    position = F.row_number().over(Window.partitionBy("subject").orderBy("before"))  # at most ``budget`` characters
    names = F.array(*map(F.lit, STREAMS))
    return kept.select("subject", position.alias("position"), F.get(names, "stream").alias("stream"), "role", "citation", "text", F.col("before").cast("long").alias("before"))


def context_text(blocks: DataFrame) -> DataFrame:
    """subject, text, citations: the assembled text, within its budget, and what it cites, in order."""
    b = F.array_sort(F.collect_list(F.struct("position", "text", "citation")))
    got = blocks.groupBy("subject").agg(b.alias("b"))
    cites = F.filter(F.transform("b", lambda x: x["citation"]), lambda x: x.isNotNull())
    return got.select("subject", F.array_join(F.transform("b", lambda x: x["text"]), GAP).alias("text"), cites.alias("citations"))
