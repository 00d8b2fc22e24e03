"""Pictures in tables, in the texts given to a model, and on pages that don't show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeline.functions.compose import blank, let
from lakeline.functions.text import escape_cell

#: Characters of a caption that stand within a marker at most.
HINT = 80
MARKER = r"\[IMG:(\d+)([^\]]*)\]"


def render_tables(tables: DataFrame, images: DataFrame) -> DataFrame:
    """``table_id, markdown`` of tables ``(table_id, headers, rows)`` with their ``images(table_id, pos, path)`` in place.

    The picture column is the one with the most blank cells, at least half of them; the first of equals. Its blank cells
    take the pictures in order, except in rows at least half of whose cells are blank; pictures left over follow below.
    Placeholder headers are blank. A table without headers has no text; rows are as wide as the headers.
    """
    shown = images.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("p")).select("table_id", F.transform("p", lambda x: x["path"]).alias("paths"))
    base = tables.where(F.size("headers") > 0).join(shown, "table_id", "left")
    width = F.size("headers")
    filled = F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(r, i), F.lit(""))))
    mark = lambda p: F.concat(F.lit("[IMG_PATH:"), p, F.lit("]"))
    line = lambda a: F.concat(F.lit("|"), F.array_join(F.transform(a, lambda c: F.concat(F.lit(" "), F.trim(escape_cell(c)), F.lit(" |"))), ""))

    def column(empty: Column) -> Column:
        """The place of the picture column, or null."""
        counts = F.transform("headers", lambda _, i: F.size(F.filter(empty, lambda e: F.get(e, i))))
        return let(counts, lambda n: F.when((2 * F.array_max(n) >= F.size(empty)) & (F.array_max(n) > 0), (F.array_position(n, F.array_max(n)) - 1).cast("int")))

    def free_rows(empty: Column, into: Column) -> Column:
        free = lambda e: F.get(e, into) & (2 * F.size(F.filter(e, lambda x: x)) < width)
        return F.array_compact(F.transform(empty, lambda e, i: F.when(free(e), i)))

    def body(cells: Column, paths: Column, free: Column, into: Column) -> Column:
        taken = F.slice(free, 1, F.size(paths))
        path = lambda row: F.get(paths, (F.nullif(F.array_position(taken, row), F.lit(0)) - 1).cast("int"))
        put = lambda r, p: F.when(p.isNull(), r).otherwise(F.transform(r, lambda c, i: F.when(i == into, mark(p)).otherwise(c)))
        lines = F.transform(cells, lambda r, row: let(path(row), lambda p: line(put(r, p))))
        rest = F.transform(F.slice(paths, F.size(free) + 1, F.greatest(F.size(paths) - F.size(free), F.lit(0))), mark)
        return F.concat(lines, F.array_compact(rest))

    paths = F.coalesce("paths", F.array().cast("array<string>"))
    lines = let(filled, lambda c: let(F.transform(c, lambda r: F.transform(r, blank)), lambda e: let(column(e), lambda into: let(free_rows(e, into), lambda free: body(c, paths, free, into)))))
    head = F.transform("headers", lambda h, i: F.when(h == F.concat(F.lit("col"), (i + 1).cast("string")), "").otherwise(h))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return base.select("table_id", F.concat_ws("\n", line(head), rule, lines).alias("markdown"))


def caption_of(told: Column) -> Column:
    """The caption behind a marker's number: without blanks and dashes or a colon in front; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(told), r"^[ —–:-]+", "")), F.lit(""))


def number_images(context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, images): ``q_id, rank, content`` with every marker ``[IMG:n caption]`` that names one of the chunk's paths
    turned into ``[[IMG-K: caption]]``, K counting through a question's chunks in order of ``rank``; and the map
    ``q_id, number, path, caption``. ``context`` needs q_id, rank, content, paths. Numbers that name no path stay as they
    are, so do all markers of a chunk without paths; within a marker a caption is cut to HINT characters and its
    brackets are round. A null content is empty."""
    content = F.coalesce("content", F.lit(""))
    names = F.transform(F.regexp_extract_all(content, F.lit(MARKER), F.lit(1)), lambda n: F.try_to_number(n, F.lit("999999999")).cast("int"))
    x = context.select("q_id", "rank", F.split(content, MARKER).alias("between"), F.regexp_extract_all(content, F.lit(MARKER), F.lit(0)).alias("marks"), F.regexp_extract_all(content, F.lit(MARKER), F.lit(2)).alias("told"), names.alias("names"), "paths")
    path = F.transform("names", lambda n: F.when(n > 0, F.get(F.col("paths"), n - 1)))
    x = x.withColumn("found", path).withColumn("own", F.size(F.filter("found", lambda p: p.isNotNull())))
    before = Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("from", F.coalesce(F.sum("own").over(before), F.lit(0)))
    number = lambda i: F.col("from") + F.size(F.filter(F.slice("found", 1, i + 1), lambda p: p.isNotNull()))
    numbered = F.transform("found", lambda p, i: F.struct(p.alias("path"), number(i).alias("number"), caption_of(F.get("told", i)).alias("caption")))
    x = x.withColumn("m", numbered)

    def marker(m: Column, i: Column) -> Column:
        plain = F.trim(F.replace(F.translate(m["caption"], "[]", "()"), F.lit("\n"), F.lit(" ")))
        hint = F.when(F.length(plain) > HINT, F.concat(F.rtrim(F.left(plain, F.lit(HINT))), F.lit("…"))).otherwise(plain)
        told = F.coalesce(F.concat(F.lit(": "), hint), F.lit(""))
        return F.when(m["path"].isNull(), F.get("marks", i)).otherwise(F.concat(F.lit("[[IMG-"), m["number"], told, F.lit("]]")))

    pairs = F.transform("m", lambda m, i: F.concat(marker(m, i), F.get("between", i + 1)))
    texts = x.select("q_id", "rank", F.concat(F.get("between", F.lit(0)), F.array_join(pairs, "")).alias("content"))
    images = x.select("q_id", F.explode(F.filter("m", lambda m: m["path"].isNotNull())).alias("m")).select("q_id", F.col("m.number").alias("number"), "m.path", "m.caption")
    return texts, images


def orphan_images(embedded: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, uri`` of the pictures ``embedded(page_id, uri)`` that their page ``(page_id, html)`` does not hold
    anywhere; a page that is missing or null holds none. Repeated pictures count once."""
    x = embedded.select("page_id", "uri").distinct().join(pages.select("page_id", "html"), "page_id", "left")
    held = F.coalesce(F.contains(F.col("html"), F.col("uri")), F.lit(False))
    return x.groupBy("page_id", "uri").agg(F.max(held).alias("held")).where("NOT held").select("page_id", "uri")
