"""Queries of graphs.  Parts depend on the part of half their key; line items of an order stand for its sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import graph as G
from corvane.operators import knowledge as K
from corvane.operators.louvain import louvain, modularity
from corvane.sources.tables import table


def _edges(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(s, d, "part").filter(k >= 2).select(k.alias("src"), F.floor(k / 2).cast("long").alias("dst"))


def transitive_deps(s: SparkSession, d: str) -> DataFrame:
    return G.closure(_edges(s, d))


def section_context(s: SparkSession, d: str) -> DataFrame:
    """How many sections come before each in its context, and the first of them in order."""
    return G.closure(_edges(s, d)).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("first"))


def one_hop_expand(s: SparkSession, d: str) -> DataFrame:
    seeds = table(s, d, "part").filter("p_size > 45").select(F.col("p_partkey").alias("seed"))
    return G.one_hop(seeds, _edges(s, d))


def _sections(s: SparkSession, d: str) -> DataFrame:
    """Statements written from line items: one for each order, a preamble and a numbered part for each line number.

    A part refers to another by number, to two by a list, or to the one before.
    """
    li = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord")).agg(F.max("l_partkey").alias("p"))
    a, b = F.pmod("p", F.lit(7)) + 1, F.pmod(F.floor(F.col("p") / 7), F.lit(7)) + 1
    text = F.when(F.pmod("p", F.lit(3)) == 0, F.format_string("Como en la Parte %d se vio", a)).when(F.pmod("p", F.lit(3)) == 1, F.format_string("Use las partes %d y %d aqui", a, b)).otherwise(F.lit("Repita la parte anterior"))
    parts = li.select("doc", "ord", F.format_string("Parte %d — tema", "ord").alias("title"), text.alias("text"))
    heads = li.select("doc").distinct().select("doc", F.lit(0).alias("ord"), F.lit("Tarea").alias("title"), F.lit("").alias("text"))
    return G.identify(heads.unionByName(parts), "doc")


def section_ids(s: SparkSession, d: str) -> DataFrame:
    """Ids of conversation turns titled by their role: a repeated title gets its number."""
    c = table(s, d, "conversations").groupBy("conv_id", F.col("turn").alias("ord")).agg(F.max("role").alias("title"))
    return G.identify(c, "conv_id").select("conv_id", "ord", "id")


def reference_edges(s: SparkSession, d: str) -> DataFrame:
    return G.reference_edges(_sections(s, d), "doc").select("doc", "src", "dst", "rule", "evidence")


def _mentions(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    return p.select(
        F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("type"),
        F.substring(F.concat("p_brand", "p_type"), F.lit(1), (F.col("p_size") % 9 + 3).cast("int")).alias("description"), F.col("p_brand").alias("source"), F.col("p_partkey").alias("seq"),
    )


def entity_merge(s: SparkSession, d: str) -> DataFrame:
    return G.merge_entities(_mentions(s, d)).withColumn("sources", F.array_join("sources", ","))


def relation_merge(s: SparkSession, d: str) -> DataFrame:
    """Parts on one order line each relate the brand to the part's name; only known names count."""
    p = table(s, d, "part").select("p_partkey", "p_name")
    r = p.select(F.col("p_name").alias("source"), F.col("p_partkey").alias("seq"), (F.col("p_partkey") + 1).alias("next")).join(p.select(F.col("p_partkey").alias("next"), F.col("p_name").alias("target")), "next")
    known = G.merge_entities(_mentions(s, d).filter("seq % 3 = 0")).select("key")
    return G.merge_relations(r.select("source", "target", F.concat(F.lit("r"), "seq").alias("label"), "seq"), known)


def entity_context(s: SparkSession, d: str) -> DataFrame:
    """Suppliers that a part's lines name, then suppliers one key away, at most fifteen for each part."""
    mentioned = table(s, d, "lineitem").select(F.col("l_partkey").alias("section"), F.col("l_suppkey").alias("entity")).distinct()
    supp = table(s, d, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"))
    return G.entity_context(mentioned, supp).select("section", "entity", F.col("place").cast("int").alias("place"))


def communities(s: SparkSession, d: str) -> DataFrame:
    """Customers by shared nation and segment: every customer is linked to the next of its kind."""
    from pyspark.sql import Window

    c = table(s, d, "customer")
    nxt = F.lead("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    return G.communities(c.select(F.col("c_custkey").alias("src"), nxt.alias("dst")).filter("dst is not null"))


def node_kinds(s: SparkSession, d: str) -> DataFrame:
    return _sections(s, d).groupBy(F.coalesce("section_kind", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _circles(s: SparkSession, d: str) -> DataFrame:
    """Circles of seven suppliers in a row of keys, all linked to the next three, and a weak link from each circle to the next."""
    k = table(s, d, "supplier").select(F.col("s_suppkey").alias("src"))
    near = k.select("src", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("far")).select("src", (F.col("src") + F.col("far")).alias("dst"))
    both = near.join(k.select(F.col("src").alias("dst")), "dst", "left_semi")
    apart = F.floor(F.col("src") / 7) != F.floor(F.col("dst") / 7)
    return both.filter(~apart | (F.col("dst") - F.col("src") == 1)).select("src", "dst", F.when(apart, 0.05).otherwise(1.0).alias("weight"))


def modularity_communities(s: SparkSession, d: str) -> DataFrame:
    """Parts of one brand and size, each linked to the next three: small circles, every one of which is a community of its own."""
    from pyspark.sql import Window

    p, group = table(s, d, "part"), Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    nxt = p.select(F.col("p_partkey").alias("src"), F.array(*[F.lead("p_partkey", k).over(group) for k in (1, 2, 3)]).alias("to"))
    return louvain(nxt.select("src", F.explode("to").alias("dst")).filter("dst IS NOT NULL")).select("node", "community", "size")


def modularity_reached(s: SparkSession, d: str) -> DataFrame:
    """One row: nodes that communities hold, links, the modularity of the planted circles, and whether the one found is no less."""
    edges = _circles(s, d)
    got = louvain(edges, least=1)
    planted = got.select("node", F.floor(F.col("node") / 7).alias("community"))
    mine, theirs = modularity(edges, got), modularity(edges, planted)
    counts = got.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("node").alias("apart"))
    return counts.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("links")))).select("nodes", "apart", "links", F.lit(round(theirs, 6)).alias("planted"), F.lit(mine >= theirs - 1e-9).alias("reached"))


def _statement(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A graph written from parts: every part is a section that mentions its brand; brands are entities of the manufacturer."""
    p, none = table(s, d, "part"), F.lit(None).cast("string")
    nodes = p.select(F.concat(F.lit("sec:"), "p_partkey").alias("id"), F.lit("section").alias("kind"), F.col("p_name").alias("name"), none.alias("type"), none.alias("description"), F.array().cast("array<string>").alias("sources"))
    brands = p.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_type").alias("type"), F.min("p_name").alias("description"))
    nodes = nodes.unionByName(brands.select(F.concat(F.lit("ent:"), "name").alias("id"), F.lit("entity").alias("kind"), "name", "type", "description", F.array(F.lit("statement"), F.lit("annex")).alias("sources")))
    return nodes, p.select(F.concat(F.lit("sec:"), "p_partkey").alias("src"), F.concat(F.lit("ent:"), "p_brand").alias("dst"), F.lit("menciona").alias("kind"), none.alias("label"))


def _notes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Another graph, from suppliers' lines: brands that suppliers deliver, with other descriptions, and suppliers as entities."""
    p, li = table(s, d, "part").select("p_partkey", "p_brand"), table(s, d, "lineitem").select("l_partkey", "l_suppkey")
    sold = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    brands = sold.groupBy(F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    text = F.repeat(F.lit("sold "), (F.col("n") % 9).cast("int"))
    nodes = brands.select(F.concat(F.lit("ent:"), "name").alias("id"), F.lit("entity").alias("kind"), F.lower("name").alias("name"), F.lit("brand").alias("type"), text.alias("description"), F.array(F.lit("notes")).alias("sources"))
    supp = table(s, d, "supplier").select(F.concat(F.lit("ent:s"), "s_suppkey").alias("id"), F.lit("entity").alias("kind"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"), F.lit("").alias("description"), F.array(F.lit("notes")).alias("sources"))
    edges = sold.groupBy(F.concat(F.lit("ent:s"), "l_suppkey").alias("src"), F.concat(F.lit("ent:"), "p_brand").alias("dst")).agg(F.count(F.lit(1)).cast("string").alias("label"))
    own = _statement(s, d)[1].select("src", "dst", F.lit("relacion").alias("kind"), F.lit("late").alias("label"))  # pairs that the statement has
    return nodes.unionByName(supp), edges.select("src", "dst", F.lit("relacion").alias("kind"), "label").unionByName(own)


def graph_merge_nodes(s: SparkSession, d: str) -> DataFrame:
    return K.merge(_statement(s, d), _notes(s, d))[0].withColumn("sources", F.array_join("sources", ","))


def graph_merge_edges(s: SparkSession, d: str) -> DataFrame:
    return K.merge(_statement(s, d), _notes(s, d))[1]


def _brand_communities(s: SparkSession, d: str) -> DataFrame:
    """Brands by their first figure: node, community, size."""
    b = table(s, d, "part").select(F.concat(F.lit("ent:"), "p_brand").alias("node"), F.substring("p_brand", 1, 7).alias("community")).distinct()
    return b.join(b.groupBy("community").agg(F.count(F.lit(1)).alias("size")), "community").select("node", "community", "size")


def community_nodes(s: SparkSession, d: str) -> DataFrame:
    """Community nodes with their summaries, and how many members point to each."""
    found = _brand_communities(s, d)
    keys = K.community_key(found)
    nodes, edges = K.with_communities(*K.merge(_statement(s, d), _notes(s, d)), found, keys.select("key", F.concat(F.lit("about "), "community").alias("summary")))
    of = edges.filter("kind = 'pertenece_a'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("members"))
    return nodes.filter("kind = 'community'").join(of, "id").select(F.col("description").alias("summary"), "members", F.col("id").rlike("^com:[0-9]+$").alias("named"))


def community_keys(s: SparkSession, d: str) -> DataFrame:
    return K.community_key(_brand_communities(s, d))


def ranked_entities(s: SparkSession, d: str) -> DataFrame:
    """Suppliers that a part's lines name, by order, then those one relation away, the ones pointed to first."""
    mentioned = table(s, d, "lineitem").select(F.col("l_partkey").alias("section"), F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("seq"))
    k = F.col("s_suppkey")
    supp = table(s, d, "supplier").select(k.alias("src"), F.explode(F.array(k * 3 % 100, k + 1)).alias("dst"))
    return K.ranked_entities(mentioned, supp.withColumn("seq", F.col("src") * 1000 + F.col("dst"))).select("section", "entity", F.col("place").cast("int").alias("place"))


def shared_entities(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    return K.shared_entities(li.select(F.col("l_orderkey").alias("section"), F.year("l_shipdate").alias("source"), F.col("l_partkey").alias("entity")))


CONTEXT_CHARS = 600


def context_blocks(s: SparkSession, d: str) -> DataFrame:
    """The context of every part: the parts it depends on and itself, its suppliers, its brand's summary, its largest lines, earlier results."""
    p, li = table(s, d, "part"), table(s, d, "lineitem")
    own = p.select(F.col("p_partkey").alias("k"), "p_name", "p_type", "p_brand")
    title = F.concat(F.lit("parts · "), F.col("k").cast("string"))
    cite, none = F.concat(title, F.lit(" · p. 1")), F.lit(None).cast("string")
    deps = G.closure(_edges(s, d)).unionByName(p.select(F.col("p_partkey").alias("src"), F.col("p_partkey").alias("dst")))
    role = F.when(F.col("src") == F.col("dst"), "section").otherwise("dependency")
    place = F.when(F.col("src") == F.col("dst"), F.lit(1 << 40)).otherwise(F.col("dst"))
    closure = deps.join(own, F.col("dst") == F.col("k")).select(F.col("src").alias("subject"), place.alias("place"), role.alias("role"), cite.alias("citation"), K.cited(cite, role, F.col("p_name")).alias("text"))
    named = li.groupBy(F.col("l_partkey").alias("section"), F.col("l_suppkey").alias("entity")).agg(F.min("l_orderkey").alias("seq"))
    chosen = K.ranked_entities(named, named.select(F.col("entity").alias("src"), F.col("entity").alias("dst"), "seq").limit(0))
    supp = table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"), F.array(F.lit("lines")).alias("sources"), F.lit("delivers").alias("description"))
    entities = K.entity_lines(chosen.withColumnRenamed("section", "subject").join(supp, "entity")).select("subject", F.lit(0).alias("place"), F.lit("entities").alias("role"), none.alias("citation"), "text")
    summaries = own.select(F.col("k").alias("subject"), F.lit(0).alias("place"), F.lit("communities").alias("role"), none.alias("citation"), F.concat(F.lit("[knowledge graph · community summaries]\n- "), "p_brand").alias("text"))
    from pyspark.sql import Window

    best = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber"))
    hit = F.concat(F.lit("lines · "), F.col("l_orderkey").cast("string"))
    score = F.concat(F.lit("similar, score "), F.col("l_quantity").cast("long").cast("string"))
    hits = li.withColumn("place", best).filter("place <= 3").select(F.col("l_partkey").alias("subject"), "place", F.lit("similar").alias("role"), hit.alias("citation"), K.cited(hit, score, F.col("l_shipdate").cast("date").cast("string")).alias("text"))
    result = F.concat(F.lit("[results of subtask "), F.col("dst").cast("string"), F.lit(", for reference only]\n"), F.substring("p_type", 1, K.RESULT_CHARS))
    results = _edges(s, d).join(own, F.col("dst") == F.col("k")).select(F.col("src").alias("subject"), F.lit(0).alias("place"), F.lit("results").alias("role"), none.alias("citation"), result.alias("text"))
    return K.assemble({"closure": closure, "entities": entities, "communities": summaries, "similar": hits, "results": results}, CONTEXT_CHARS)


def context_texts(s: SparkSession, d: str) -> DataFrame:
    got = K.context_text(context_blocks(s, d))
    return got.select("subject", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("chars"), F.array_join("citations", "|").alias("citations"))


QUERIES = {
    f.__name__: f
    for f in (
        transitive_deps, section_context, one_hop_expand, section_ids, reference_edges, entity_merge, relation_merge, entity_context, communities, node_kinds, modularity_communities, modularity_reached,
        graph_merge_nodes, graph_merge_edges, community_nodes, community_keys, ranked_entities, shared_entities, context_blocks, context_texts,
    )
}

_LINKS = """near AS (SELECT s_suppkey AS src, s_suppkey + f AS dst FROM supplier, range(1, 4) r(f)),
  e AS (SELECT src, dst, CASE WHEN src // 7 <> dst // 7 THEN 0.05 ELSE 1.0 END AS w FROM near WHERE dst IN (SELECT s_suppkey FROM supplier) AND (src // 7 = dst // 7 OR dst - src = 1))"""
_STATEMENT = """sn AS (SELECT 'sec:' || p_partkey AS id, 'section' AS kind, p_name AS name, NULL AS type, NULL AS description, CAST([] AS VARCHAR[]) AS sources FROM part
    UNION ALL SELECT 'ent:' || p_brand, 'entity', p_brand, min(p_type), min(p_name), ['statement', 'annex'] FROM part GROUP BY p_brand),
  se AS (SELECT 'sec:' || p_partkey AS src, 'ent:' || p_brand AS dst FROM part),
  nn AS (SELECT 'ent:' || p_brand AS id, 'entity' AS kind, lower(p_brand) AS name, 'brand' AS type, repeat('sold ', count(*) % 9) AS description, ['notes'] AS sources FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand
    UNION ALL SELECT 'ent:s' || s_suppkey, 'entity', s_name, 'supplier', '', ['notes'] FROM supplier),
  ne AS (SELECT 'ent:s' || l_suppkey AS src, 'ent:' || p_brand AS dst, CAST(count(*) AS VARCHAR) AS label FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
_CONTEXT = """cl AS (SELECT src, dst FROM c UNION ALL SELECT p_partkey, p_partkey FROM part),
  named AS (SELECT l_partkey AS k, l_suppkey AS e, min(l_orderkey) AS seq FROM lineitem GROUP BY 1, 2),
  ent AS (SELECT k, e, row_number() OVER (PARTITION BY k ORDER BY seq, e) AS place FROM named),
  hit AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS place FROM lineitem),
  raw AS (SELECT src AS subject, 0 AS st, CASE WHEN src = dst THEN 1099511627776 ELSE dst END AS place, CASE WHEN src = dst THEN 'section' ELSE 'dependency' END AS role, 'parts · ' || dst || ' · p. 1' AS citation,
      '[parts · ' || dst || ' · p. 1] (' || CASE WHEN src = dst THEN 'section' ELSE 'dependency' END || ')' || chr(10) || p_name AS text FROM cl JOIN part ON p_partkey = dst
    UNION ALL SELECT k, 1, 0, 'entities', NULL, '[knowledge graph · entities]' || chr(10) || string_agg('- ' || s_name || ' (supplier; lines): delivers', chr(10) ORDER BY place) FROM ent JOIN supplier ON s_suppkey = e WHERE place <= 15 GROUP BY k
    UNION ALL SELECT p_partkey, 2, 0, 'communities', NULL, '[knowledge graph · community summaries]' || chr(10) || '- ' || p_brand FROM part
    UNION ALL SELECT l_partkey, 3, place, 'similar', 'lines · ' || l_orderkey, '[lines · ' || l_orderkey || '] (similar, score ' || CAST(l_quantity AS BIGINT) || ')' || chr(10) || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) FROM hit WHERE place <= 3
    UNION ALL SELECT a.p_partkey, 4, 0, 'results', NULL, '[results of subtask ' || b.p_partkey || ', for reference only]' || chr(10) || b.p_type FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2 WHERE a.p_partkey >= 2),
  summed AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY subject ORDER BY st, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM raw),
  cut AS (SELECT *, bool_or(before + length(text) > 600) OVER (PARTITION BY subject ORDER BY st, place) AS late FROM summed),
  blocks AS (SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY st, place) AS INTEGER) AS position, (['closure', 'entities', 'communities', 'similar', 'results'])[st + 1] AS stream, role, citation, text, CAST(before AS BIGINT) AS before FROM cut WHERE NOT late)"""

_CLOSURE = "WITH RECURSIVE c(src, dst) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey >= 2 UNION SELECT c.src, c.dst // 2 FROM c WHERE c.dst >= 2)"
_FOLDED = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_M = "SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_type AS type, substring(p_brand || p_type, 1, p_size % 9 + 3) AS description, p_brand AS source, p_partkey AS seq FROM part"
_SECTIONS = """sec AS (SELECT l_orderkey AS doc, l_linenumber AS ord, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
  docs AS (SELECT DISTINCT doc FROM sec)"""
SQL = {
    "transitive_deps": _CLOSURE + " SELECT src, dst FROM c",
    "section_context": _CLOSURE + " SELECT src, count(*) AS n, min(dst) AS first FROM c GROUP BY src",
    "one_hop_expand": "SELECT p_partkey AS seed, p_partkey AS node FROM part WHERE p_size > 45 UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_size > 45 AND p_partkey >= 2",
    "section_ids": """WITH c AS (SELECT conv_id, turn AS ord, max(role) AS role FROM conversations GROUP BY 1, 2),
      b AS (SELECT conv_id, ord, CASE WHEN ord = 0 THEN 'preambulo' ELSE role END AS i FROM c)
      SELECT conv_id, ord, i || CASE WHEN row_number() OVER (PARTITION BY conv_id, i ORDER BY ord) > 1 THEN '-' || ord ELSE '' END AS id FROM b""",
    "reference_edges": f"""WITH {_SECTIONS},
      t AS (SELECT doc, ord, p, p % 7 + 1 AS a, (p // 7) % 7 + 1 AS b, p % 3 AS m FROM sec),
      r AS (SELECT doc, ord AS o, a AS d, 'Como en la Parte ' || a || ' se vio' AS e, 0 AS q FROM t WHERE m = 0
        UNION ALL SELECT doc, ord, a, 'Use las partes ' || a || ' y ' || b || ' aqui', 0 FROM t WHERE m = 1
        UNION ALL SELECT doc, ord, b, 'Use las partes ' || a || ' y ' || b || ' aqui', 1 FROM t WHERE m = 1),
      f AS (SELECT DISTINCT r.doc, o, d, e FROM r JOIN sec s ON s.doc = r.doc AND s.ord = r.d WHERE o <> d
        UNION SELECT t.doc, t.ord, (SELECT max(s.ord) FROM sec s WHERE s.doc = t.doc AND s.ord < t.ord), 'Repita la parte anterior' FROM t WHERE m = 2),
      g AS (SELECT * FROM f WHERE d IS NOT NULL)
      SELECT doc, 'parte-' || o AS src, 'parte-' || d AS dst, 'reference' AS rule, e AS evidence FROM g
      UNION ALL SELECT doc, 'parte-' || ord, 'preambulo', 'preamble', NULL FROM sec""",
    "entity_merge": f"""WITH m AS ({_M}), k AS (SELECT *, {_FOLDED.format(x="name")} AS key FROM m)
      SELECT key, arg_min(name, seq) AS name, arg_min(type, seq) AS type, arg_max(description, (length(description), -seq)) AS description, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM k GROUP BY key""",
    "relation_merge": f"""WITH known AS (SELECT DISTINCT {_FOLDED.format(x="p_name")} AS key FROM part WHERE p_partkey % 3 = 0),
      r AS (SELECT {_FOLDED.format(x="a.p_name")} AS src, {_FOLDED.format(x="b.p_name")} AS dst, a.p_partkey AS seq FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
      SELECT src, dst, 'r' || max(seq) AS label FROM r WHERE src <> dst AND src IN (SELECT key FROM known) AND dst IN (SELECT key FROM known) GROUP BY src, dst""",
    "entity_context": """WITH m AS (SELECT DISTINCT l_partkey AS section, l_suppkey AS entity FROM lineitem),
      e AS (SELECT section, entity, 0 AS far FROM m UNION ALL SELECT section, s_suppkey + 1, 1 FROM m JOIN supplier ON s_suppkey = entity UNION ALL SELECT section, s_suppkey, 1 FROM m JOIN supplier ON s_suppkey + 1 = entity),
      u AS (SELECT section, entity, min(far) AS far FROM e GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY far, entity) AS place FROM u)
      SELECT section, entity, CAST(place AS INTEGER) AS place FROM p WHERE place <= 15""",
    "node_kinds": f"WITH {_SECTIONS} SELECT 'parte' AS kind, count(*) AS n FROM sec UNION ALL SELECT 'none', count(*) FROM docs",
    "modularity_communities": """WITH g AS (SELECT p_partkey AS node, min(p_partkey) OVER w AS community, count(*) OVER w AS size FROM part WINDOW w AS (PARTITION BY p_brand, p_size))
      SELECT * FROM g WHERE size >= 3""",
    "modularity_reached": f"""WITH {_LINKS}, sides AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e),
      per AS (SELECT src // 7 AS c, sum(w) AS tot, sum(CASE WHEN src // 7 = dst // 7 THEN w ELSE 0 END) AS inn FROM sides GROUP BY 1)
      SELECT (SELECT count(DISTINCT src) FROM sides) AS nodes, (SELECT count(DISTINCT src) FROM sides) AS apart, (SELECT count(*) FROM e) AS links, CAST(round(sum(inn) / sum(tot) - sum(tot * tot) / (sum(tot) * sum(tot)), 6) AS DOUBLE) AS planted, TRUE AS reached FROM per""",
    "graph_merge_nodes": f"""WITH {_STATEMENT}
      SELECT coalesce(a.id, b.id) AS id, coalesce(a.kind, b.kind) AS kind, CASE WHEN a.id IS NULL THEN b.name ELSE a.name END AS name, CASE WHEN a.id IS NULL THEN b.type ELSE a.type END AS type,
        CASE WHEN a.id IS NULL OR (b.id IS NOT NULL AND length(b.description) > length(a.description)) THEN b.description ELSE a.description END AS description,
        array_to_string(CASE WHEN a.id IS NULL THEN b.sources WHEN b.id IS NULL THEN a.sources ELSE list_sort(list_distinct(a.sources || b.sources)) END, ',') AS sources
      FROM sn a FULL OUTER JOIN nn b ON a.id = b.id""",
    "graph_merge_edges": f"WITH {_STATEMENT} SELECT src, dst, 'menciona' AS kind, NULL AS label FROM se UNION ALL SELECT src, dst, 'relacion', label FROM ne",
    "community_nodes": "SELECT 'about ' || substring(p_brand, 1, 7) AS summary, count(DISTINCT p_brand) AS members, TRUE AS named FROM part GROUP BY 1",
    "community_keys": """WITH b AS (SELECT DISTINCT 'ent:' || p_brand AS node, substring(p_brand, 1, 7) AS community FROM part)
      SELECT community, substring(sha256(count(*) || '|' || sum(CAST('0x' || substring(md5(node), 1, 15) AS HUGEINT))), 1, 16) AS key FROM b GROUP BY community""",
    "ranked_entities": """WITH m AS (SELECT l_partkey AS section, l_suppkey AS entity, min(l_orderkey) AS seq FROM lineitem GROUP BY 1, 2),
      r AS (SELECT s_suppkey AS src, d AS dst, s_suppkey * 1000 + d AS n FROM (SELECT s_suppkey, unnest([s_suppkey * 3 % 100, s_suppkey + 1]) AS d FROM supplier)),
      e AS (SELECT section, entity, 0 AS far, seq, 0 AS side, 0 AS n FROM m UNION ALL SELECT section, dst, 1, seq, 0, n FROM m JOIN r ON src = entity UNION ALL SELECT section, src, 1, seq, 1, n FROM m JOIN r ON dst = entity),
      u AS (SELECT section, entity, min((far, seq, side, n)) AS first_at FROM e GROUP BY 1, 2), p AS (SELECT section, entity, row_number() OVER (PARTITION BY section ORDER BY first_at, entity) AS place FROM u)
      SELECT section, entity, CAST(place AS INTEGER) AS place FROM p WHERE place <= 15""",
    "shared_entities": """WITH m AS (SELECT l_orderkey AS section, year(l_shipdate) AS source, l_partkey AS entity FROM lineitem), s AS (SELECT entity, count(DISTINCT source) > 1 AS many FROM m GROUP BY 1)
      SELECT section, count(DISTINCT entity) AS mentioned, count(DISTINCT CASE WHEN many THEN entity END) AS shared FROM m JOIN s USING (entity) GROUP BY section""",
    "context_blocks": f"{_CLOSURE}, {_CONTEXT} SELECT * FROM blocks",
    "context_texts": f"""{_CLOSURE}, {_CONTEXT}, t AS (SELECT subject, string_agg(text, chr(10) || chr(10) ORDER BY position) AS text, coalesce(string_agg(citation, '|' ORDER BY position), '') AS citations FROM blocks GROUP BY subject)
      SELECT subject, md5(text) AS text_md5, length(text) AS chars, citations FROM t""",
}
