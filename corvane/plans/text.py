"""Queries of text structure and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import checks as C
from corvane.sources import keyed as K
from corvane.sources.scratch import saved, scratch
from corvane.sources.tables import table


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "source", "text")


def chunk_documents(s: SparkSession, d: str) -> DataFrame:
    c = X.chunks(_docs(s, d), ["doc_id"])
    return c.select("doc_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("md5"))


def page_sections(s: SparkSession, d: str) -> DataFrame:
    """The headings of each page in order, with level and title."""
    tag = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(tag), F.lit(1)).alias("level"), F.regexp_extract_all("html", F.lit(tag), F.lit(2)).alias("title"))
    p = table(s, d, "pages").select("page_id", F.posexplode(both).alias("ord", "h"))
    return p.select("page_id", F.col("ord").cast("int").alias("ord"), F.col("h.level").cast("int").alias("level"), F.trim(F.regexp_replace("h.title", "<[^>]*>", "")).alias("title"))


def markdown_sections(s: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown: every line with an even number of characters becomes a heading."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.when((F.length(x) % 2 == 0) & (F.trim(x) != "") & (F.trim(x) == x), F.concat(F.lit("## "), x)).otherwise(x))
    md = _docs(s, d).select("doc_id", F.col("source").alias("stem"), F.array_join(lines, "\n").alias("text"))
    out = X.markdown_sections(md, "doc_id")
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), "level", F.length("body").cast("long").alias("n_chars"))


def heading_positions(s: SparkSession, d: str) -> DataFrame:
    """Where the last line of each document first stands as a heading."""
    docs = _docs(s, d)
    last = docs.select("doc_id", F.element_at(F.split("text", "\n"), -1).alias("section"))
    return X.heading_positions(docs, "doc_id", last).select("doc_id", "pos")


def fold_and_slug(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", X.fold("text").alias("folded"), X.slug("text").alias("slug"))


def word_counts(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", X.word_count("text").alias("n_words"), F.length(X.strip_code("text")).cast("long").alias("n_chars"))


def number_mentions(s: SparkSession, d: str) -> DataFrame:
    """The numbers of a sentence written from each line item, by how they are written."""
    li = table(s, d, "lineitem")
    text = F.format_string("Item %d: price %.2f, discount %.1f %%, tax rate %.3e", F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_discount") * 100, F.col("l_tax") + 0.001)
    rows = C.mention_rows(li.select("l_orderkey", text.alias("text")), "l_orderkey")
    return rows.groupBy("seq", "form", "decimals").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("seq").cast("int").alias("seq"), F.col("form").cast("int").alias("form"), F.col("decimals").cast("int").alias("decimals"), "n", "total")


def json_props(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def json_flatten(s: SparkSession, d: str) -> DataFrame:
    """Each event as a nested document, flattened to its paths."""
    doc = F.to_json(F.struct(F.struct(F.col("event_type").alias("type"), F.array(F.col("user_id"), F.col("event_id")).alias("ids")).alias("head"), F.array(F.struct(F.floor("value").alias("v"))).alias("rows")))
    flat = C.flatten(table(s, d, "events").select("event_id", doc.alias("doc")), ["event_id"], "doc")
    return flat.select("event_id", "path", "value")


def section_fill(s: SparkSession, d: str) -> DataFrame:
    """Conversations as documents: turns of users are headings, of level 1 or 2, the others text below them."""
    c = table(s, d, "conversations").groupBy("conv_id", F.col("turn").alias("pos")).agg(F.max("role").alias("role"), F.max("text").alias("text"))
    items = c.select("conv_id", "pos", F.when(F.col("role") == "user", F.col("pos") % 2 + 1).alias("level"), F.when(F.col("role") == "user", F.concat(F.lit("Turn  "), "pos")).otherwise(F.col("text")).alias("text"), F.floor(F.col("pos") / 3).alias("page"))
    return X.filled_sections(items, "conv_id").select("conv_id", "section", "title", "level", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def snippets(s: SparkSession, d: str) -> DataFrame:
    """What stands around the first full stop of each document."""
    at = F.instr("text", ".")
    return _docs(s, d).filter(at > 0).select("doc_id", X.trim_cut_words(X.snippet("text", at, F.lit(1), 20)).alias("snippet"))


def replace_by_key(s: SparkSession, d: str) -> DataFrame:
    """Documents kept by source; the sources with an odd number are then ingested again, shorter; ids by name."""
    path = f"{scratch(s)}/keyed-{d.strip('/').replace('/', '_').replace(':', '')}-{s.sparkContext.applicationId}"
    rows = _docs(s, d).select("source", "doc_id", F.length("text").cast("long").alias("n"), K.uuid5(F.concat_ws("#", "source", "doc_id")).alias("id"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("source").parquet(path)
    K.replace_by_key(rows.filter(F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 1).filter("doc_id % 3 = 0"), path, "source")
    return saved(s.read.schema("doc_id long, n long, id string, source string").parquet(path), "keyed")


def cache_miss(s: SparkSession, d: str) -> DataFrame:
    """Texts of 80 characters or more that no labelled document holds, one row for each key."""
    docs = _docs(s, d).filter(F.length(F.trim("text")) >= 80).select("doc_id", K.cache_key(F.lit("v1"), F.col("text")).alias("key"))
    known = docs.join(table(s, d, "labels").select("doc_id"), "doc_id", "left_semi").select("key").distinct()
    return K.missing(docs.groupBy("key").agg(F.min("doc_id").alias("doc_id")), known, "key")


def font_levels(s: SparkSession, d: str) -> DataFrame:
    """Parts as lines of text, their size as the font: the body size and the heading levels."""
    lines = table(s, d, "part").select(F.round(F.col("p_size") * 0.5, 1).alias("size"), F.length(F.trim("p_name")).alias("n"))
    sizes = lines.groupBy("size").agg(F.sum("n").alias("weight"))
    body = sizes.agg(F.max_by("size", F.struct("weight", -F.col("size"))).alias("body"))
    heads = sizes.crossJoin(F.broadcast(body)).filter(F.col("size") >= 1.15 * F.col("body"))
    return heads.select("size", "body", F.dense_rank().over(Window.partitionBy("body").orderBy(F.desc("size"))).cast("int").alias("level"))


def islands(s: SparkSession, d: str) -> DataFrame:
    """Runs of turns whose texts are all short or all long, joined into one block each."""
    c = table(s, d, "conversations").withColumn("short", F.length("text") < 200)
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = c.withColumn("edge", F.coalesce((F.lag("short").over(own) != F.col("short")).cast("int"), F.lit(0)))
    c = c.withColumn("island", F.sum("edge").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("conv_id", "island").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"), F.min("turn").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (chunk_documents, page_sections, markdown_sections, heading_positions, fold_and_slug, word_counts, number_mentions, json_props, json_flatten, section_fill, snippets, replace_by_key, cache_miss, font_levels, islands)
}

_FOLD = r"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"
SQL = {
    "section_fill": """WITH c AS (SELECT conv_id, turn, max(role) AS role, max(text) AS text FROM conversations GROUP BY 1, 2),
      p AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM c)
      SELECT conv_id, CAST(section AS BIGINT) AS section, coalesce('Turn ' || max(turn) FILTER (role = 'user'), '') AS title, coalesce(max(turn % 2 + 1) FILTER (role = 'user'), 0) AS level, min(turn) // 3 AS page, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role <> 'user'), '')) AS text_md5 FROM p GROUP BY 1, 2""",
    "chunk_documents": r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM documents),
      p AS (SELECT doc_id, i AS chunk_idx, t[i * 1200 + 1 : (i + 1) * 1200] AS piece, CASE WHEN i > 0 THEN right(t[(i - 1) * 1200 + 1 : i * 1200], 200) || chr(10) || chr(10) ELSE '' END AS carried
            FROM (SELECT doc_id, t, unnest(range(0, (length(t) + 1199) // 1200)) AS i FROM t))
      SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, length(carried || piece) AS n_chars, md5(carried || piece) AS md5 FROM p""",
    "page_sections": r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS l, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS t FROM pages)
      SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, CAST(l[i] AS INTEGER) AS level, trim(regexp_replace(t[i], '<[^>]*>', '', 'g'), ' ') AS title FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM h)""",
    "markdown_sections": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
      h AS (SELECT *, length(line) % 2 = 0 AND trim(line, ' ') <> '' AND trim(line, ' ') = line AS head FROM l),
      o AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS ord FROM h)
      SELECT doc_id, CAST(ord AS BIGINT) AS ord, CASE WHEN bool_or(head) THEN 2 ELSE 0 END AS level,
        CAST(coalesce(length(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head)), 0) AS BIGINT) AS n_chars FROM o GROUP BY doc_id, ord""",
    "heading_positions": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
      o AS (SELECT doc_id, n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_at,
              regexp_replace({_FOLD.format(x="ltrim(line, '# ')")}, '^[0-9]+ ', '') AS h, line FROM l),
      t AS (SELECT doc_id, {_FOLD.format(x="arg_max(line, n)")} AS target FROM l GROUP BY doc_id)
      SELECT t.doc_id, CAST(coalesce(min(pos_at) FILTER (h <> '' AND (h = target OR starts_with(h, target || ' ') AND length(h) <= length(target) + 40)), -1) AS BIGINT) AS pos
      FROM t JOIN o USING (doc_id) GROUP BY t.doc_id""",
    "fold_and_slug": rf"""SELECT doc_id, {_FOLD.format(x="text")} AS folded, replace({_FOLD.format(x="text")}, ' ', '-') AS slug FROM documents""",
    "word_counts": r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words, length(text) AS n_chars FROM documents",
    "number_mentions": """WITH v AS (SELECT l_linenumber AS a, l_extendedprice AS b, round(l_discount * 100, 1) AS c, CAST(format('{:.3e}', l_tax + 0.001) AS DOUBLE) AS t FROM lineitem),
      m AS (SELECT 0 AS seq, 0 AS form, 0 AS decimals, CAST(a AS DOUBLE) AS value FROM v UNION ALL SELECT 1, 0, 2, round(b, 2) FROM v UNION ALL SELECT 2, 0, 1, c FROM v UNION ALL SELECT 2, 1, 3, c / 100 FROM v
        UNION ALL SELECT 3, 0, CASE WHEN t < 0.01 THEN 6 ELSE 5 END, t FROM v)
      SELECT CAST(seq AS INTEGER) AS seq, CAST(form AS INTEGER) AS form, CAST(decimals AS INTEGER) AS decimals, count(*) AS n, round(sum(value), 3) AS total FROM m GROUP BY seq, form, decimals""",
    "json_props": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "json_flatten": """SELECT event_id, 'head.type' AS path, event_type AS value FROM events UNION ALL SELECT event_id, 'head.ids[0]', CAST(user_id AS VARCHAR) FROM events
      UNION ALL SELECT event_id, 'head.ids[1]', CAST(event_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'rows[0].v', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) FROM events""",
    "snippets": r"""WITH t AS (SELECT doc_id, instr(text, '.') AS pos_at, text FROM documents WHERE instr(text, '.') > 0),
      w AS (SELECT doc_id, list_filter(regexp_split_to_array(substring(text, greatest(1, pos_at - 20), pos_at + 21 - greatest(1, pos_at - 20)), '\s+'), lambda x: x <> '') AS w FROM t)
      SELECT doc_id, array_to_string(CASE WHEN len(w) > 2 THEN w[2:len(w) - 1] ELSE w END, ' ') AS snippet FROM w""",
    "replace_by_key": f"""WITH r AS (SELECT source, doc_id, length(text) AS n, sha1(unhex('{K.NAMESPACE.replace("-", "")}') || encode(source || '#' || doc_id)) AS h FROM documents)
      SELECT source, doc_id, n, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], ('89ab')[CAST(('0x' || h[17:17]) AS INTEGER) % 4 + 1] || h[18:20], h[21:32]) AS id FROM r
      WHERE CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 2 = 0 OR doc_id % 3 = 0 OR source NOT IN (SELECT source FROM documents WHERE doc_id % 3 = 0)""",
    "cache_miss": """WITH k AS (SELECT doc_id, sha256('v1' || chr(0) || text)[1:24] AS key FROM documents WHERE length(trim(text, ' ')) >= 80)
      SELECT key, min(doc_id) AS doc_id FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY key""",
    "font_levels": """WITH s AS (SELECT round(p_size * 0.5::DOUBLE, 1) AS size, sum(length(trim(p_name))) AS w FROM part GROUP BY 1), b AS (SELECT arg_max(size, (w, -size)) AS body FROM s)
      SELECT size, body, CAST(dense_rank() OVER (ORDER BY size DESC) AS INTEGER) AS level FROM s, b WHERE size >= 1.15::DOUBLE * body""",
    "islands": """WITH c AS (SELECT *, length(text) < 200 AS short FROM conversations),
      e AS (SELECT *, coalesce(CAST(lag(short) OVER w <> short AS INTEGER), 0) AS edge FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
      i AS (SELECT *, CAST(sum(edge) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM e)
      SELECT conv_id, island, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, min(turn) AS first FROM i GROUP BY conv_id, island""",
}
