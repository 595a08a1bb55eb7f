"""Section and entity graphs: identity, references, closures, context, communities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import SETTINGS
from corvane.functions.text import fold, slug, snippet
from corvane.sources.scratch import saved

#: The kinds of numbered sections, and the patterns of their titles and of references to them.
KINDS = "parte|pregunta|ejercicio|secci[oó]n|punto|actividad"
NUMBERED = rf"(?i)^\s*({KINDS})\s+(\d+)\b"
REFERENCE = rf"(?i)\b({KINDS})s?\s+(\d+(?:\s*(?:,|y|e|o)\s*\d+)*)"
PREVIOUS = rf"(?i)\b(?:la|el)\s+({KINDS})\s+(?:anterior|previa|previo)\b"
PREAMBLE = "preambulo"
#: Rounds of label propagation in which all nodes change at once, and labels jump along chains.
JUMPS = 32


def identify(sections: DataFrame, doc: str) -> DataFrame:
    """Adds section_kind, number and id to (doc, ord, title, ...).

    A numbered title gives kind-number, the first section that is not numbered the preamble, any other its slug; an id
    that stood before in the document gets its order number.
    """
    kind = slug(F.regexp_extract("title", NUMBERED, 1))
    number = F.regexp_extract("title", NUMBERED, 2)
    df = sections.withColumn("section_kind", F.when(number != "", kind)).withColumn("number", F.when(number != "", number))
    plain = F.when(F.col("number").isNotNull(), F.concat_ws("-", "section_kind", "number")).when(F.col("ord") == 0, PREAMBLE).when(slug("title") == "", "seccion").otherwise(slug("title"))
    again = F.row_number().over(Window.partitionBy(doc, "_id").orderBy("ord")) > 1
    return df.withColumn("_id", plain).withColumn("id", F.when(again, F.concat_ws("-", "_id", F.col("ord").cast("string"))).otherwise(F.col("_id"))).drop("_id")


def reference_edges(sections: DataFrame, doc: str) -> DataFrame:
    """doc, src, dst, rule, evidence: from numbered references, from "the one before", and to the preamble.

    A reference goes to the last section of its kind and number; one to itself is dropped; of several between the same
    two sections the last one's evidence stays.  Every other section depends on the preamble unless it refers to it.
    """
    s = sections.select(doc, "ord", "id", "section_kind", "number", "text")
    labels = s.filter("number is not null").groupBy(doc, F.col("section_kind").alias("kind"), F.col("number").alias("n")).agg(F.max_by("id", "ord").alias("dst"))
    refs = s.select(doc, "id", "text", F.posexplode(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0))).alias("seq", "m"))
    refs = refs.withColumn("kind", slug(F.regexp_extract("m", REFERENCE, 1)))
    refs = refs.select(doc, F.col("id").alias("src"), "text", "seq", "m", "kind", F.posexplode(F.regexp_extract_all("m", F.lit(r"\d+"), F.lit(0))).alias("k", "n"))
    direct = refs.join(labels, [doc, "kind", "n"]).withColumn("order", F.struct(F.lit(0).alias("a"), "seq", "k"))
    before = Window.partitionBy(doc, "kind").orderBy("ord").rangeBetween(Window.unboundedPreceding, -1)
    prev = s.select(doc, "ord", "id", "text", F.posexplode_outer(F.regexp_extract_all("text", F.lit(PREVIOUS), F.lit(0))).alias("seq", "m"))
    asked = prev.filter("m is not null").withColumn("kind", slug(F.regexp_extract("m", PREVIOUS, 1)))
    marks = s.select(doc, "ord", F.col("section_kind").alias("kind"), F.col("id").alias("own"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("m"))
    both = marks.unionByName(asked.select(doc, "ord", "kind", F.lit(None).cast("string").alias("own"), F.col("id").alias("src"), "text", "seq", "m"))
    both = both.withColumn("dst", F.last("own", True).over(before))
    earlier = both.filter("src is not null and dst is not null").withColumn("order", F.struct(F.lit(1).alias("a"), "seq", F.lit(0).alias("k")))
    cols = [doc, "src", "dst", "order", "text", "m"]
    found = direct.select(*cols).unionByName(earlier.select(*cols)).filter("src <> dst")
    found = found.groupBy(doc, "src", "dst").agg(F.max_by(F.struct("text", "m"), "order").alias("e"))
    found = found.select(doc, "src", "dst", F.lit("reference").alias("rule"), snippet(F.col("e.text"), F.instr(F.col("e.text"), F.col("e.m")), F.length("e.m")).alias("evidence"))
    head = s.filter(F.col("id") == PREAMBLE).select(doc, F.col("id").alias("dst"))
    rest = s.filter(F.col("id") != PREAMBLE).select(doc, F.col("id").alias("src")).join(head, doc).join(found.select(doc, "src", "dst"), [doc, "src", "dst"], "left_anti")
    return found.unionByName(rest.select(doc, "src", "dst", F.lit("preamble").alias("rule"), F.lit(None).cast("string").alias("evidence")))


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """src, dst: all that can be reached from src over one edge or more, src itself left out even on cycles.

    Each round doubles the length of the paths, so the rounds grow with the logarithm of the longest path.  A round puts only the
    longest of the shortest paths before others, so that in a tree a pair is met once; what it finds is written to the shared folder.
    """
    near = saved(edges.select("src", "dst").filter("src <> dst").distinct().withColumn("steps", F.lit(1).cast("long")), "reach")
    parts, edge = [near], near
    for i in range(most):
        if not edge.take(1):
            return near.select("src", "dst")
        ahead = edge.select(F.col("src").alias("_from"), F.col("dst").alias("src")).join(near, "src").filter("_from <> dst")
        more = ahead.groupBy(F.col("_from").alias("src"), "dst").agg((F.min("steps") + 2**i).alias("steps")).join(near.select("src", "dst"), ["src", "dst"], "left_anti")
        parts.append(saved(more, "reach"))
        near, edge = reduce(DataFrame.unionByName, parts), parts[-1].filter(F.col("steps") == 2 ** (i + 1))
    raise ValueError(f"paths of more than 2**{most} edges")


def one_hop(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """seed, node: the seeds and what they depend on directly."""
    return seeds.select("seed", F.col("seed").alias("node")).unionByName(seeds.join(edges, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node"))).distinct()


def merge_entities(mentions: DataFrame) -> DataFrame:
    """key, name, type, description, sources of mentions (name, type, description, source, seq).

    Mentions without a name are left out; names that fold alike are one entity; name and type are those first seen, the description is the longest, the first
    of equals; sources are sorted.  All parts are combined before the shuffle.
    """
    return mentions.filter(F.trim("name") != "").withColumn("key", fold("name")).groupBy("key").agg(
        F.min_by("name", "seq").alias("name"),
        F.min_by("type", "seq").alias("type"),
        F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def merge_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """src, dst, label: relations between two different known entities; the latest label of a pair stays."""
    known = entities.select("key")
    r = relations.withColumn("src", fold("source")).withColumn("dst", fold("target")).filter("src <> dst")
    r = r.join(known, r["src"] == known["key"], "left_semi").join(known, r["dst"] == known["key"], "left_semi")
    return r.groupBy("src", "dst").agg(F.max_by("label", "seq").alias("label"))


def entity_context(mentioned: DataFrame, relations: DataFrame, cap: int = SETTINGS.entity_cap) -> DataFrame:
    """section, entity, place: the entities a section mentions, then those one relation away, at most ``cap``."""
    both = relations.select("src", "dst").unionByName(relations.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = mentioned.join(both, F.col("entity") == F.col("src")).select("section", F.col("dst").alias("entity"), F.lit(1).alias("far"))
    every = mentioned.select("section", "entity", F.lit(0).alias("far")).unionByName(near).groupBy("section", "entity").agg(F.min("far").alias("far"))
    place = F.row_number().over(Window.partitionBy("section").orderBy("far", "entity"))
    return every.withColumn("place", place).filter(F.col("place") <= cap)


def communities(edges: DataFrame, rounds: int = 1000, least: int = SETTINGS.community_min_size) -> DataFrame:
    """node, community: label propagation over the undirected edges, communities of ``least`` nodes or more.

    In each round a node takes the label that most of its neighbours (and itself) have, the least of equals.  Rounds are
    written to the shared folder and end when no label changes; if labels still change after ``rounds``, that is an error.
    On chains, where a label would go one node a round, a node of at most two neighbours that shares no label takes the
    label that its own label's node has by now, if smaller: labels go twice as far each round.  After JUMPS such rounds
    only nodes that come before all their neighbours that would change do change; so each round gains equal neighbours or
    lowers labels, and two sides cannot swap labels for ever.
    """
    both = saved(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct(), "sides")
    start = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label"), (F.count(F.lit(1)) <= 2).alias("thin"))
    labels = saved(start.withColumnRenamed("src", "node"), "labels")
    for r in range(rounds):
        votes = both.join(labels, both["dst"] == labels["node"]).select(F.col("src").alias("node"), "label").unionByName(labels.select("node", "label"))
        best = votes.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("best"), F.max("n").alias("n"))
        new = saved(labels.join(best, "node"), "votes")
        moving = new.filter("best <> label").select("node")
        if not moving.take(1):
            size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
            return labels.join(size, "label").select("node", F.col("label").alias("community"), "size")
        if r < JUMPS:
            of = new.filter("thin").select(F.col("node").alias("of"), F.col("best").alias("far"))
            far = new.join(of, new["best"] == of["of"], "left")
            label = F.when(F.col("thin") & (F.col("n") == 1) & (F.col("far") < F.col("best")), F.col("far")).otherwise(F.col("best"))
            labels = saved(far.select("node", label.alias("label"), "thin"), "labels")
        else:
            blocked = both.join(moving.withColumnRenamed("node", "src"), "src").join(moving.withColumnRenamed("node", "dst"), "dst").filter("dst < src").select(F.col("src").alias("node")).distinct()
            turn = moving.join(blocked, "node", "left_anti").withColumn("turn", F.lit(True))
            labels = saved(new.join(turn, "node", "left").select("node", F.when(F.col("turn"), F.col("best")).otherwise(F.col("label")).alias("label"), "thin"), "labels")
    raise ValueError(f"labels still change after {rounds} rounds")
