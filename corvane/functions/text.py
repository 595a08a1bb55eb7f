"""Text as columns: words, folding, slugs, snippets, lines and sections.  All but NFKC run in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import SETTINGS



@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition without combining marks makes of every character beyond ASCII.

    Two strings for translate (characters that become one letter or digit, then combining marks, which go), and the
    characters that become several.
    """
    one, gone, many = {}, [], {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)]):
        if unicodedata.combining(c):
            gone.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and re.search("[a-z0-9]", plain):
            (one if len(plain) == 1 else many)[c] = plain
    return "".join([*one, *gone]), "".join(one.values()), many


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Lower-cased words of two or more word characters, in order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def _ranges(of: Iterable[str]) -> str:
    """A character class of neighbouring characters as ranges."""
    points, out = sorted(map(ord, of)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]"


def compatible(text: pd.Series) -> pd.Series:
    """NFKC, for PDF text: ligatures and full-width forms become plain letters."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column | str) -> Column:
    """NFKC of a text; texts of ASCII alone, which it does not change, stay in the JVM."""
    odd = F.when(~_col(text).rlike(r"^\p{ASCII}*$"), _col(text))
    return F.coalesce(F.pandas_udf(compatible, "string")(odd), _col(text))


def truncated(text: Column | str, most: int, mark: str = "") -> Column:
    """The first ``most`` characters, with ``mark`` after them if any were cut."""
    return F.when(F.length(_col(text)) > most, F.concat(F.substring(_col(text), 1, most), F.lit(mark))).otherwise(_col(text))


def word_count(text: Column | str) -> Column:
    """White-space separated words; a lone mark counts."""
    return F.size(F.filter(F.split(F.trim(_col(text)), r"\s+"), lambda w: w != "")).cast("long")


def fold(text: Column | str) -> Column:
    """Lower case without accents; everything else than a-z and 0-9 becomes one space."""
    matching, replace, many = _folds()
    beyond = r"[^\x00-\x7F]"
    low = F.lower(_col(text))
    low = F.when(low.rlike(beyond), F.translate(low, matching, replace)).otherwise(low)
    table = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    spread = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    low = F.when(low.rlike(beyond) & low.rlike(_ranges(many)), spread).otherwise(low)  # few texts hold a character that becomes several
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def slug(text: Column | str) -> Column:
    return F.replace(fold(text), F.lit(" "), F.lit("-"))


def strip_code(text: Column | str) -> Column:
    """The text without fenced blocks."""
    return F.regexp_replace(_col(text), "(?s)```.*?```", "")


def longest_code(reply: Column | str) -> Column:
    """The longest fenced python block of a reply, else the whole reply if it imports something, else null."""
    found = F.regexp_extract_all(_col(reply), F.lit(r"(?s)```(?:python|py)?\s*\n(.*?)```"), F.lit(1))
    longest = F.reduce(found, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.when(longest != "", longest).when(F.contains(_col(reply), F.lit("import ")), _col(reply))


def lenient_json(text: Column | str) -> Column:
    """From the first { to the last }, if that is valid JSON."""
    found = F.regexp_extract(_col(text), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def snippet(text: Column | str, start: Column, length: Column, width: int = 40) -> Column:
    """``width`` characters on either side of a match (start from 1), white space collapsed."""
    low = F.greatest(F.lit(1), start - width)
    return F.trim(F.regexp_replace(F.substring(_col(text), low, start + length + width - low), r"\s+", " "))


def trim_cut_words(text: Column | str) -> Column:
    """A snippet of fixed width without its first and last word, if it has more than two."""
    ws = F.split(F.trim(_col(text)), r"\s+")
    return F.when(F.size(ws) > 2, F.array_join(F.slice(ws, 2, F.size(ws) - 2), " ")).otherwise(F.array_join(ws, " "))


def thousands(n: Column | str) -> Column:
    return F.replace(F.format_number(_col(n), 0), F.lit(","), F.lit(" "))


def join_lines(text: Column | str) -> Column:
    """Lines into one, a word cut by a hyphen at a line's end put together if the next line begins in lower case."""
    marked = F.replace(_col(text), F.lit("\n"), F.lit("\u0001"))
    return F.replace(F.regexp_replace(marked, r"(?U)(?<=\w)-\u0001(?=\p{javaLowerCase})", ""), F.lit("\u0001"), F.lit(" "))


def decimal_figures(text: Column | str) -> Column:
    """Decimal figures and percentages as written, outside of code."""
    return F.regexp_extract_all(strip_code(text), F.lit(r"0[.,]\d{2,4}|\d{2}[.,]\d{1,2}\s?%"), F.lit(0))


def script_hash(code: Column | str) -> Column:
    """A digest that blank lines and white space at line ends do not change."""
    lines = F.filter(F.transform(F.split(F.trim(_col(code)), "\n"), lambda x: F.rtrim(x)), lambda x: F.trim(x) != "")
    return F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 16)


def markdown_row(cells: list[Column]) -> Column:
    """A row of a Markdown table, bars in cells escaped."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]), F.lit(" |"))


def chunks(df: DataFrame, key: list[str], text: str = "text", size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """key, chunk_idx, chunk: paragraphs packed greedily into chunks of about ``size`` characters.

    Paragraphs are cut at ``size``.  A chunk that is full carries its last ``overlap`` characters into the next one, so
    with its separator a chunk may reach size + overlap + 2.  The fold runs over one text's pieces, in the JVM.
    """
    paragraphs = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    cut = F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size)), lambda i: F.substring(p, i.cast("int") * size + 1, F.lit(size))))
    empty = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, piece: Column) -> Column:
        full = (a["cur"] != "") & (F.length(a["cur"]) + F.length(piece) + 2 > size)
        cur = F.when(full, F.right(a["cur"], F.lit(overlap))).otherwise(a["cur"])
        return F.struct(
            F.when(cur != "", F.concat(cur, F.lit("\n\n"), piece)).otherwise(piece).alias("cur"),
            F.when(full, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]).alias("out"),
        )

    packed = F.aggregate("_pieces", empty, step, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))
    return df.withColumn("_pieces", F.flatten(cut)).select(*key, F.posexplode(packed).alias("chunk_idx", "chunk"))


def markdown_sections(df: DataFrame, key: str, text: str = "text", stem: str = "stem") -> DataFrame:
    """key, ord, title, level, body: a Markdown text cut at its headings.

    Headings inside closed fences do not count; an unclosed fence is no fence.  Text before the first heading is titled
    by the file's stem.  Lines are numbered within each text, so a window never spans two texts.
    """
    lines = df.select(key, F.col(stem).alias("_stem"), F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    own = Window.partitionBy(key)
    upto = own.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*```").cast("int")
    lines = lines.withColumn("_f", F.sum(fence).over(upto)).withColumn("_all", F.sum(fence).over(own))
    inside = (F.col("_f") % 2 == 1) & ((F.col("_f") < F.col("_all")) | (F.col("_all") % 2 == 0))
    head = F.regexp_extract("line", r"^(#{1,6})\s+(.+?)\s*#*\s*$", 2)
    lines = lines.withColumn("_head", F.when(~inside & F.col("line").rlike(r"^#{1,6}\s+\S"), head))
    lines = lines.withColumn("ord", F.sum(F.col("_head").isNotNull().cast("int")).over(upto))
    return lines.groupBy(key, "ord").agg(
        F.coalesce(F.max("_head"), F.max("_stem")).alias("title"),
        F.coalesce(F.max(F.when(F.col("_head").isNotNull(), F.length(F.regexp_extract("line", "^(#+)", 1)))), F.lit(0)).cast("int").alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_head").isNull(), F.struct("n", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )


def heading_positions(df: DataFrame, key: str, targets: DataFrame, text: str = "text") -> DataFrame:
    """key, section, pos: where the first line stands that is the heading ``section`` of ``targets`` (key, section); -1 if none."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    lines = lines.withColumn("h", F.regexp_replace(fold(F.regexp_replace("line", "^[# ]+", "")), r"^\d+ ", "")).filter("h <> ''")
    wanted = targets.withColumn("target", fold("section"))
    hit = (F.col("h") == F.col("target")) | F.startswith(F.col("h"), F.concat("target", F.lit(" "))) & (F.length("h") <= F.length("target") + SETTINGS.heading_slack)
    return wanted.join(lines, key, "left").groupBy(key, "section").agg(F.coalesce(F.min(F.when(hit, F.col("at"))), F.lit(-1)).cast("long").alias("pos"))


def filled_sections(items: DataFrame, doc: str) -> DataFrame:
    """doc, section, title, level, page, text: the items of a document (doc, pos, level, text, page) gathered below their headings.

    An item with a level is a heading; text before any heading stands in a section without title, of level 0.  Texts are joined by an
    empty line.
    """
    upto = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = items.withColumn("section", F.sum(F.col("level").isNotNull().cast("long")).over(upto))
    head = F.col("level").isNotNull()
    body = F.array_sort(F.collect_list(F.when(~head, F.struct("pos", "text"))))
    return placed.groupBy(doc, "section").agg(
        F.coalesce(F.max(F.when(head, F.trim(F.regexp_replace("text", r"\s+", " ")))), F.lit("")).alias("title"), F.coalesce(F.max("level"), F.lit(0)).alias("level"),
        F.min_by("page", "pos").alias("page"), F.array_join(F.transform(body, lambda x: x["text"]), "\n\n").alias("text"),
    )
