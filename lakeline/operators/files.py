"""Files, their rows and their images."""

from __future__ import annotations

import csv
import io
import re
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, size, hash, format`` of every file of a folder in one pass."""
    from lakeline.functions.text import doc_format

    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.upper(F.sha2("content", 256)).alias("hash"), doc_format(F.col("content")).alias("format"))


def decode_text(content: Column) -> Column:
    """UTF-8 or UTF-16 by byte order mark, else UTF-8 if valid, else windows-1254."""
    upper = [(chr(b), bytes([b]).decode("cp1254", "replace")) for b in range(128, 256)]
    turned = [(a, c) for a, c in upper if c not in (a, "\ufffd")]  # bytes that windows-1254 leaves open stay as in Latin-1
    head = F.hex(F.substr(content, F.lit(1), F.lit(3)))
    rest = lambda n: F.substr(content, F.lit(n))
    return (
        F.when(head == "EFBBBF", F.decode(rest(4), "UTF-8")).when(head.startswith("FFFE"), F.decode(rest(3), "UTF-16LE")).when(head.startswith("FEFF"), F.decode(rest(3), "UTF-16BE"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.translate(F.decode(content, "ISO-8859-1"), "".join(a for a, _ in turned), "".join(c for _, c in turned)))
    )


def delimiter_of(text: str) -> str:
    """The rule of ``chunking.sniff_delimiter`` on one text."""
    lines = list(islice((x for x in text.replace("\r", "").split("\n") if x.strip(" ")), 30))
    bare = [re.sub(r'"[^"]*"', "", x) if '"' in x else x for x in lines]
    best, found = 0.0, ","
    for d in (";", ",", "\t", "|"):
        counts = [n for n in [x.count(d) for x in bare] if n]
        if counts:
            f, n = max((counts.count(n), n) for n in set(counts))
            if 10.0 * f / len(bare) + n > best:
                best, found = 10.0 * f / len(bare) + n, d
    return found


def delimited_cells(files: DataFrame) -> DataFrame:
    """``file_id, cells``: the rows of each of the files ``(file_id, text)`` as one array; files without rows are left out."""
    schema = files.select("file_id", F.array(F.array(F.lit(""))).alias("cells")).schema
    arrow = to_arrow_schema(schema)
    offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())

    def run(batches):
        csv.field_size_limit(1 << 30)
        for b in batches:
            rows, per_file = [], []
            for t in b.column("text").to_pylist():
                before = len(rows)
                if t:
                    rows += [r for r in csv.reader(io.StringIO(t, newline=""), delimiter=delimiter_of(t)) if "".join(r).strip()]
                per_file.append(len(rows) - before)
            cells = pa.ListArray.from_arrays(offsets([len(r) for r in rows]), pa.array([c for r in rows for c in r], pa.string()))
            cells = pa.ListArray.from_arrays(offsets(per_file), cells).cast(arrow.field(1).type)
            yield pa.RecordBatch.from_arrays([b.column("file_id").cast(arrow.field(0).type), cells], schema=arrow)

    return files.select("file_id", "text").mapInArrow(run, schema).where(F.size("cells") > 0)


def delimited_to_rows(files: DataFrame) -> DataFrame:
    """``file_id, row_idx, cells`` of files ``(file_id, text)``: the delimiter is sniffed, quotes may hold delimiters, line
    ends and doubled quotes; rows of blank cells are left out and do not count. A file is read within its row."""
    return delimited_cells(files).select("file_id", F.posexplode("cells").alias("row_idx", "cells"))


def delimited_tables(files: DataFrame) -> DataFrame:
    """``file_id, markdown``: delimited files with their table part as a pipe table."""
    from lakeline.operators.markdown import sheet_markdown

    return delimited_cells(files).select("file_id", sheet_markdown(F.col("cells")).alias("markdown"))


def anchor_images(cells: DataFrame, pictures: DataFrame, least: int = 64) -> DataFrame:
    """Cells ``(sheet, row, col, text)`` with `` [IMG_PATH:p]`` for each picture ``(sheet, row, col, path, size)`` on them;
    pictures without a cell go to a cell behind the last row of the sheet; small ones are left out."""
    good = pictures.where(F.col("size") >= least)
    mark = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "path"))), lambda x: F.concat(F.lit(" [IMG_PATH:"), x.path, F.lit("]"))), "")
    held = good.join(cells.select("sheet", "row", "col"), ["sheet", "row", "col"], "left_semi").groupBy("sheet", "row", "col").agg(mark([]).alias("marks"))
    free = good.join(cells.select("sheet", "row", "col"), ["sheet", "row", "col"], "left_anti").groupBy("sheet").agg(mark(["row", "col"]).alias("marks"))
    end = cells.groupBy("sheet").agg((F.max("row") + 1).alias("row"), F.min("col").alias("col"))
    tail = free.join(end, "sheet").select("sheet", "row", "col", F.ltrim("marks").alias("text"))
    return cells.join(held, ["sheet", "row", "col"], "left").select("sheet", "row", "col", F.concat("text", F.coalesce("marks", F.lit(""))).alias("text")).unionByName(tail)


def attach_captions(chunks: DataFrame, captions: DataFrame) -> DataFrame:
    """Adds ``captions`` to chunks ``(chunk_id, paths array)``: one for each path in order, empty where there is none."""
    x = chunks.select("chunk_id", F.posexplode("paths").alias("pos", "path")).join(captions.select("path", "caption"), "path", "left")
    per = x.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("caption", F.lit("")).alias("c")))), lambda r: r.c).alias("captions"))
    return chunks.join(per, "chunk_id", "left").withColumn("captions", F.coalesce("captions", F.array().cast("array<string>")))


def hash_except_same_page(embedded: DataFrame, seen: DataFrame, least: int = 64) -> DataFrame:
    """Embedded pictures of ``least`` bytes or more whose hash was not seen on the same page of the document."""
    return embedded.where(F.col("size") >= least).join(seen.select("doc_id", "page", "hash"), ["doc_id", "page", "hash"], "left_anti")


def persist_images(chunks: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, links): the images of documents, first by path, then by hash, and ``chunk_id, path, position`` links to
    them. ``chunks`` needs doc_id, chunk_id, chunk_idx and the array paths; ``hashes`` path, hash."""
    x = chunks.select("doc_id", "chunk_id", "chunk_idx", F.posexplode("paths").alias("pos", "path")).join(hashes, "path", "left").withColumn("k", F.coalesce("hash", F.concat(F.lit("#"), "path")))
    first = x.groupBy("doc_id", "k").agg(F.min(F.struct("chunk_idx", "pos", "path", "hash")).alias("f"))
    images = first.select("doc_id", F.col("f.path").alias("path"), F.col("f.hash").alias("hash"))
    links = x.join(first.select("doc_id", "k", F.col("f.path").alias("image_path")), ["doc_id", "k"]).select("chunk_id", F.col("image_path").alias("path"), (F.col("pos") + 1).alias("position"))
    return images, links


def append_exchange(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Messages with a user and an assistant row for each turn ``(session_id, user_message_id, question, answer, at)``; the
    answer has the next id and refers to the question."""
    q = turns.select(F.col("user_message_id").alias("message_id"), "session_id", F.lit(0).alias("role"), F.col("question").alias("content"), F.lit(None).cast("long").alias("response_to"), F.col("at").alias("created"))
    a = turns.select((F.col("user_message_id") + 1).alias("message_id"), "session_id", F.lit(1).alias("role"), F.col("answer").alias("content"), F.col("user_message_id").alias("response_to"), F.col("at").alias("created"))
    return messages.select(q.columns).unionByName(q).unionByName(a)


def split_items(items: DataFrame, key: str, order: str, cost: str, budget: int, head_cost: Column | int = 0) -> DataFrame:
    """``key, piece, first, n, cost``: a list or table cut into pieces within ``budget``; ``head_cost`` (a repeated header,
    a number or a column that is one number within a key) is charged to each piece. ``first`` keeps the number at which a
    list goes on. A piece that is only one item may exceed the budget; null costs count as 0."""
    from lakeline.operators.folds import number_runs

    head = F.coalesce((F.lit(head_cost) if isinstance(head_cost, int) else head_cost).cast("long"), F.lit(0))

    def step(s, cost, head):
        no, used = s
        return (no + 1, cost) if used > 0 and head + used + cost > budget else (no, used + cost)

    x = items.select(key, order, F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("_cost"), head.alias("_head"))
    numbered = number_runs(x, key, order, {"cost": F.col("_cost"), "head": F.col("_head")}, (0, 0), step, "piece", ["_cost", "_head"])
    return numbered.groupBy(key, "piece").agg(F.min(order).alias("first"), F.count("*").alias("n"), (F.sum("_cost") + F.max("_head")).alias("cost"))


def semantic_breaks(windows: DataFrame, threshold: str = "threshold", most: int = 400, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, idx, piece``, with the columns named by ``carry``, of windows ``(doc_id, idx, tokens, distance, threshold)`` in order; ``distance`` is that to the
    window before. A piece ends before a window that is farther than the threshold or would make it too long."""
    from lakeline.operators.folds import number_runs

    def step(s, tokens, far):
        no, used = s
        return (no + 1, tokens) if used > 0 and (used + tokens > most or far) else (no, used + tokens)

    fields = {"tokens": F.coalesce(F.col("tokens").cast("long"), F.lit(0)), "far": F.coalesce(F.col("distance") > F.col(threshold), F.lit(False))}
    return number_runs(windows, "doc_id", "idx", fields, (0, 0), step, "piece", carry)


def semantic_pieces(texts: DataFrame, most: int = 400, window: int = 80, p: float = 0.85, model=None) -> DataFrame:
    """``doc_id, piece, text`` of ``texts(doc_id, text)``: a text within ``most`` words is one piece as it is; others are
    cut into windows of ``window`` words, embedded, and broken where neighbours are farther apart than the document's
    percentile or the piece is full. Pieces are trimmed, blank texts give none. ``model(table, column)`` adds embeddings.
    ``doc_id`` must be unique."""
    from lakeline.functions.compose import blank, let
    from lakeline.functions.text import count_tokens
    from lakeline.functions.vector import cosine
    from lakeline.operators.answers import embed
    from lakeline.operators.chunking import breakpoints
    from lakeline.sources.shared import settle

    x = texts.select("doc_id", "text").where(~blank(F.col("text")))
    whole = x.where(count_tokens(F.col("text")) <= most).select("doc_id", F.lit(0).alias("piece"), "text")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    cut = x.where(count_tokens(F.col("text")) > most).select("doc_id", words.alias("w"))
    windows = let(F.col("w"), lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(window)), lambda at: F.array_join(F.slice(w, at, F.lit(window)), " ")))
    rows = cut.select("doc_id", F.posexplode(windows).alias("idx", "text"))  # a row holds its window, not the document
    before = F.lag("embedding").over(Window.partitionBy("doc_id").orderBy("idx"))
    told = (model or embed)(rows, "text").withColumn("_b", before)
    far = settle(told.select("doc_id", "idx", "text", F.when(F.col("_b").isNotNull(), 1 - cosine(F.col("_b"), F.col("embedding"))).alias("distance")))
    w = far.join(breakpoints(far, p), "doc_id", "left").withColumn("tokens", count_tokens(F.col("text")))
    broken = semantic_breaks(w, most=most, carry=["text"])
    joined = broken.groupBy("doc_id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda r: r.text), " ").alias("text"))
    return whole.unionByName(joined)


def merge_same_header(chunks: DataFrame, most: int) -> DataFrame:
    """``doc_id, chunk_idx, merged``: consecutive chunks ``(doc_id, chunk_idx, header, tokens)`` of one header whose tokens
    together stay within ``most`` share a number."""
    from lakeline.operators.folds import number_runs

    def step(s, header, tokens):
        no, used, last = s
        return (no, used + tokens, header) if header == last and used + tokens <= most else (no + 1, tokens, header)

    fields = {"header": F.coalesce("header", F.lit("")), "tokens": F.coalesce(F.col("tokens").cast("long"), F.lit(0))}
    return number_runs(chunks, "doc_id", "chunk_idx", fields, (-1, 0, None), step, "merged")


def generate(prompts: DataFrame, model, default: str = "") -> DataFrame:
    """Adds ``answer``: ``model(list of prompts) -> list of texts`` on Arrow batches; each distinct prompt is asked once
    and a batch that fails gets ``default``."""

    @F.pandas_udf("string")
    def ask(s: pd.Series) -> pd.Series:
        try:
            return pd.Series(model(s.tolist()), dtype=object)
        except Exception:  # the model is not ours; the documented value stands in
            return pd.Series([default] * len(s), dtype=object)

    distinct = prompts.where("prompt IS NOT NULL").select("prompt").distinct()
    return prompts.join(distinct.select("prompt", ask("prompt").alias("answer")), "prompt", "left")


