"""Blocks of a document cut into chunks by section, kind and budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeline.functions.text import count_tokens, escape_cell
from lakeline.operators.folds import number_runs

#: Kinds that are never mixed with others, and those that may be cut when they are too large.
ATOMIC = {"hierarchical": {"table", "code"}, "semantic": {"table", "code", "math"}}
CUTTABLE = {"table", "code"}


def block_units(blocks: DataFrame) -> DataFrame:
    """``doc_id, block, page, kind, header_path, unit, text, tokens, head, head_tokens`` of blocks ``(doc_id, block, page,
    kind, header_path, text, headers, rows)``: rows of a table (``head`` is its header line and rule), otherwise lines."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: escape_cell(c)), " | "), F.lit(" |"))
    table = (F.col("kind") == "table") & (F.size("headers") > 0)
    shown = F.transform("headers", lambda h, i: F.when(h == F.concat(F.lit("col"), (i + 1).cast("string")), F.lit("")).otherwise(h))
    head = F.when(table, F.concat(row(shown), F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size("headers"))))
    units = F.when(table, F.transform("rows", row)).otherwise(F.split("text", "\n"))
    units = F.when(F.size(units) > 0, units).otherwise(F.array(F.lit("")))  # a table without rows
    words = lambda a: count_tokens(F.array_join(a, " "))
    x = blocks.select("doc_id", "block", "page", "kind", "header_path", head.alias("head"), F.when(table, words(F.col("headers"))).otherwise(0).alias("head_tokens"), F.posexplode(units).alias("unit", "text"))
    return x.withColumn("tokens", F.when(F.col("head").isNotNull(), count_tokens(F.replace("text", F.lit("|"), F.lit(" ")))).otherwise(count_tokens(F.col("text"))))


def split_sections(units: DataFrame, most: int | str = 512, mode: str = "hierarchical", most_atomic: int = 1024, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, block, unit, chunk``: the chunk, numbered from 0 in each document, that each unit of a block goes to;
    with the columns of ``units`` named by ``carry``.

    ``units`` needs doc_id, block, unit, kind, header_path, tokens and head_tokens; a boolean column ``far`` (semantic
    only) asks for a cut before the unit where its block is cut. ``most`` may name a column with a budget by document.

    Consecutive blocks of one header path are a section. *hierarchical*: a section within the budget is one chunk.
    Larger sections, and all with *semantic*, are filled block by block: a table or code (or, semantic, a formula) is a
    chunk of its own; a change of kind, or a block that would exceed the budget, begins a chunk; a block that is
    larger than the budget alone is cut between its units, and each piece of a table is charged its header again.
    Semantic mode cuts atomic blocks only above ``most_atomic``, and formulas never. A unit above the budget is a piece
    of its own. Null tokens count as 0, null kinds and paths as empty; an empty table gives an empty one.
    """
    atomic, semantic = ATOMIC[mode], mode == "semantic"
    doc = Window.partitionBy("doc_id").orderBy("block", "unit")
    cost = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    path = F.coalesce("header_path", F.lit(""))
    carry = carry or []
    x = units.select(
        "doc_id", "block", "unit", *(F.col(c).alias(f"_own_{c}") for c in carry), F.coalesce("kind", F.lit("")).alias("kind"), path.alias("path"), cost("tokens").alias("tokens"), cost("head_tokens").alias("head"),
        (F.col("far") if semantic and "far" in units.columns else F.lit(False)).alias("far"), (F.col(most) if isinstance(most, str) else F.lit(most)).cast("long").alias("most"),
    )
    x = x.withColumn("new", F.coalesce((F.col("path") != F.lag("path").over(doc)).cast("int"), F.lit(1))).withColumn("first", F.coalesce(F.col("block") != F.lag("block").over(doc), F.lit(True)))
    x = x.withColumn("section", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("total", F.sum("tokens").over(Window.partitionBy("doc_id", "block")) + F.col("head"))
    whole = F.sum(F.col("tokens") + F.when(F.col("first"), F.col("head")).otherwise(0)).over(Window.partitionBy("doc_id", "section"))
    x = x.withColumn("whole", whole)

    def step(s, section, first, kind, tokens, head, total, whole, far, most):
        no, used, last, before, how = s  # how: the block or section in hand is added to, stands alone, or is cut
        if not semantic and whole <= most:
            return (no, 0, "", section, "section") if section == before else (no + 1, 0, "", section, "section")
        if not first:
            if how != "cut":
                return no, used, last, section, how
            limit = most_atomic if semantic and kind in atomic else most
            return (no + 1, head + tokens, kind, section, how) if used + tokens > limit or far else (no, used + tokens, kind, section, how)
        if kind in atomic:
            limit = most_atomic if semantic else most
            return no + 1, head + tokens, kind, section, "cut" if total > limit and kind in CUTTABLE else "alone"
        if total > most:
            return no + 1, head + tokens, kind, section, "cut"
        if how == "open" and section == before and last == kind and used + total <= most:
            return no, used + total, kind, section, how
        return no + 1, total, kind, section, "open"

    names = ["section", "first", "kind", "tokens", "head", "total", "whole", "far", "most"]
    numbered = number_runs(x, "doc_id", ["block", "unit"], {n: F.col(n) for n in names}, (-1, 0, "", None, ""), step, "chunk", [f"_own_{c}" for c in carry])
    return numbered.select("doc_id", "block", "unit", *(F.col(f"_own_{c}").alias(c) for c in carry), "chunk")


def section_chunks(units: DataFrame, most: int | str = 512, mode: str = "hierarchical", most_atomic: int = 1024) -> DataFrame:
    """``doc_id, chunk, header, page, kind, content, tokens`` of the chunks that ``split_sections`` makes of the units of
    ``block_units``: units line by line, blocks a blank line apart, the header again on every piece of a table; the page
    is the first one."""
    x = split_sections(units, most, mode, most_atomic, ["page", "kind", "header_path", "head", "text", "tokens", "head_tokens"])
    by_block = x.groupBy("doc_id", "chunk", "block").agg(
        F.min(F.struct("unit", "page", "kind", "header_path", "head")).alias("f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "text"))), lambda u: u.text), "\n").alias("body"),
        (F.sum("tokens") + F.max("head_tokens")).alias("tokens"),
    )
    piece = by_block.select("doc_id", "chunk", "block", "f", "tokens", F.concat_ws("\n", "f.head", "body").alias("text"))
    one = piece.groupBy("doc_id", "chunk").agg(F.min(F.struct("block", "f")).alias("first"), F.sum("tokens").alias("tokens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b.text), "\n\n").alias("content"))
    return one.select("doc_id", "chunk", F.col("first.f.header_path").alias("header"), F.col("first.f.page").alias("page"), F.col("first.f.kind").alias("kind"), "content", "tokens")
