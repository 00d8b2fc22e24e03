"""Full-text search with a query syntax: words that must all occur, ``"phrases"``, ``or``, and ``-excluded``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lakeline.operators.index import terms
from lakeline.sources.shared import settle

TOKEN = r'-?"[^"]*"?|\S+'
#: Alternatives that are sent to the chunks in one pass.
SENT = 1 << 16


def clauses(questions: DataFrame) -> DataFrame:
    """``q_id, part, clause, excluded, words, n_clauses, n_words``: what each alternative (``part``) of a query asks for.

    A clause is a word or a phrase, repeats within a part count once; a token of several words, such as ``a-b``, is a
    phrase. ``q_id`` must be unique; null and blank queries give no rows.
    """
    tokens = questions.select("q_id", F.posexplode(F.regexp_extract_all("question", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    either = F.lower("token") == "or"
    x = tokens.withColumn("part", F.count_if(either).over(Window.partitionBy("q_id").orderBy("pos"))).where(~either)
    x = x.select("q_id", "part", F.col("token").startswith("-").alias("excluded"), terms(F.col("token")).alias("words")).where(F.size("words") > 0).distinct()
    w = Window.partitionBy("q_id", "part")
    wanted = ~F.col("excluded")
    return x.select(
        "q_id", "part", F.row_number().over(w.orderBy("excluded", "words")).alias("clause"), "excluded", "words",
        F.count_if(wanted).over(w).cast("int").alias("n_clauses"), F.sum(F.when(wanted, F.size("words")).otherwise(0)).over(w).cast("int").alias("n_words"),
    )


def positions(chunks: DataFrame, content: str = "content", chunk_id: str = "chunk_id", fields: dict[str, float] | None = None) -> DataFrame:
    """``term, chunk_id, pos, weight``: where each term stands in each chunk. With ``fields`` several columns are read one
    behind the other, a place apart so that no phrase reaches over, each with its weight; null texts are empty."""
    fields = fields or {content: 1.0}
    texts = chunks.select(F.col(chunk_id).alias("chunk_id"), *(F.coalesce(terms(F.col(f)), F.array().cast("array<string>")).alias(f"_{i}") for i, f in enumerate(fields)))
    parts, before = [], F.lit(0)
    for i, w in enumerate(fields.values()):
        parts.append(texts.select("chunk_id", before.alias("before"), F.posexplode(f"_{i}").alias("at", "term"), F.lit(w).alias("weight")))
        before = before + F.size(f"_{i}") + 1
    return reduce(DataFrame.unionByName, parts).select("term", "chunk_id", (F.col("before") + F.col("at")).alias("pos"), "weight")


def word_places(chunks: DataFrame, content: str = "content", chunk_id: str = "chunk_id", fields: dict[str, float] | None = None) -> DataFrame:
    """``chunk_id, terms, held``: what ``positions`` tells, with all places of a chunk in its own row, ``held`` in order;
    ``terms`` are the distinct ones."""
    fields = fields or {content: 1.0}
    texts = chunks.select(F.col(chunk_id).alias("chunk_id"), *(F.coalesce(terms(F.col(f)), F.array().cast("array<string>")).alias(f"_{i}") for i, f in enumerate(fields)))

    def places(i, before, w):
        return F.transform(f"_{i}", lambda t, at: F.struct((before + at).alias("pos"), t.alias("term"), F.lit(w).alias("weight")))

    parts, before = [], F.lit(0)
    for i, w in enumerate(fields.values()):
        parts.append(places(i, before, w))
        before = before + F.size(f"_{i}") + 1
    return texts.select("chunk_id", F.array_distinct(F.concat(*(f"_{i}" for i in range(len(fields))))).alias("terms"), F.concat(*parts).alias("held"))


def gathered(placed: DataFrame) -> DataFrame:
    """The rows of ``word_places`` from those of ``positions``."""
    if "held" in placed.columns:
        return placed
    by_chunk = placed.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "weight"))).alias("held"))
    return by_chunk.select("chunk_id", F.array_distinct("held.term").alias("terms"), "held")


def by_term(held: DataFrame, table: DataFrame, *key: str) -> DataFrame:
    """The rows of ``held`` with those of ``table`` whose ``term`` they hold. ``table``, a settled one, is sent to the
    chunks, ``SENT`` rows (by ``key``) in one pass, so that no words are shuffled."""
    passes = -(-table.count() // SENT) or 1
    rows = held.withColumn("term", F.explode("terms"))
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(table.where(F.pmod(F.xxhash64(*key), F.lit(passes)) == k)), "term") for k in range(passes)])


def alternatives(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``q_id, part, term, others, clauses, n_clauses, n_words`` of the alternatives whose wanted words all occur
    somewhere; ``term`` is the one that the fewest chunks hold."""
    wanted = asked.where("NOT excluded").select("q_id", "part", F.explode("words").alias("term")).distinct()
    df = by_term(held.select("terms"), settle(wanted.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df"))
    of = wanted.join(df, "term", "left").groupBy("q_id", "part").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("by_df"), F.count("*").alias("need"), F.count("df").alias("found"))
    told = asked.groupBy("q_id", "part").agg(F.collect_list(F.struct("clause", "excluded", "words")).alias("clauses"), F.max("n_clauses").alias("n_clauses"), F.max("n_words").alias("n_words"))
    return of.where("need = found").join(told, ["q_id", "part"]).select("q_id", "part", F.col("by_df.term")[0].alias("term"), F.slice("by_df.term", 2, F.col("need") - 1).alias("others"), "clauses", "n_clauses", "n_words")


def matching_rows(asked: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of ``held`` with each of the ``alternatives`` that they hold every wanted word of. The rarest word proposes
    chunks and the others are looked up within the row, so a word that stands in most chunks makes no pairs of its own."""
    found = by_term(held, settle(alternatives(asked, held)), "q_id", "part")
    n, first = F.size("others"), F.array_contains("terms", F.get("others", F.lit(0)))  # no lambda: rows are wide, and compiled code doesn't copy them
    return found.where((n == 0) | (first & ((n == 1) | (F.size(F.array_except("others", "terms")) == 0))))


def matching_chunks(asked: DataFrame, placed: DataFrame) -> DataFrame:
    """``q_id, part, chunk_id`` of the chunks that hold every wanted word of an alternative."""
    return matching_rows(asked, gathered(placed)).select("q_id", "part", "chunk_id")


def clause_hits(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Every place where a clause occurs in a chunk that holds all wanted words, with its first word's position ``begin``
    and the ``inverse`` weights of its words; phrases need their words side by side. Excluded words are looked for in these
    chunks only. Hits of a query, part and chunk come one behind the other, by position."""

    def at(word, i):
        return F.transform(F.filter("held", lambda x: x["term"] == word), lambda x: F.struct((x["pos"] - i).alias("begin"), x["weight"].alias("weight")))

    def places(words):
        rest = F.transform(F.slice(words, 2, F.size(words) - 1), lambda w, i: at(w, i + 1))
        return F.when(F.size(words) == 1, at(words[0], F.lit(0))).otherwise(F.aggregate(rest, at(words[0], F.lit(0)), lambda a, b: F.array_intersect(a, b)))

    def hits(c):
        size = F.size(c["words"])
        return F.transform(places(c["words"]), lambda x: F.struct(x["begin"].alias("begin"), c["clause"].alias("clause"), c["excluded"].alias("excluded"), size.alias("size"), (size / x["weight"]).alias("inverse")))

    every = F.array_sort(F.flatten(F.transform("clauses", hits)))
    return matching_rows(asked, held).select("q_id", "part", "chunk_id", "n_clauses", "n_words", F.explode(every).alias("x")).select("q_id", "part", "chunk_id", "n_clauses", "n_words", "x.*")


def cover_density(hits: DataFrame, weight: float = 1.0) -> DataFrame:
    """``q_id, part, chunk_id, score``: for each smallest stretch that holds every clause ``weight / (1 + other words)``,
    times the harmonic mean of the weights of its words.

    Hits come in the order of ``clause_hits`` and are streamed: a task carries the last place of each clause only. Chunks
    that lack a clause, or hold an excluded one, give no row.
    """
    keys = ["q_id", "part", "chunk_id"]
    d = hits.select(*keys, "begin", "clause", "excluded", "size", "n_clauses", "n_words", "inverse")
    schema = d.select(*keys, F.lit(0.0).alias("score")).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, before, score, barred = None, {}, -1, 0.0, False
        for b in batches:
            out = []
            for *key, begin, clause, excluded, size, n_clauses, n_words, inverse in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    if score and not barred:
                        out.append((*now, score))
                    now, last, before, score, barred = key, {}, -1, 0.0, False
                if excluded:
                    barred = True
                    continue
                last[clause] = (begin, begin + size, inverse)
                if len(last) == n_clauses:
                    first = min(x[0] for x in last.values())
                    if first > before:
                        score += weight * n_words / sum(x[2] for x in last.values()) / (1 + max(max(x[1] for x in last.values()) - first - n_words, 0))
                        before = first
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow) if out else pa.RecordBatch.from_pylist([], schema=arrow)
        if score and not barred:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, score), arrow.types)], schema=arrow)

    return d.mapInArrow(run, schema)


def web_search(questions: DataFrame, placed: DataFrame, n: int = 12, weight: float = 1.0) -> DataFrame:
    """``q_id, chunk_id, score, rank`` of the ``n`` best chunks that match a query in the syntax above.

    A chunk matches if it holds all clauses of one alternative and none that this excludes; the scores of matching
    alternatives are added. An alternative that only excludes finds nothing. Equal scores (to nine digits) go by
    chunk_id, which must be unique. ``placed`` comes from ``word_places``, then nothing of the texts is shuffled, or from
    ``positions``. Equal questions are looked up once.
    """
    once = settle(questions.select("question").distinct().withColumn("no", F.monotonically_increasing_id()))
    asked = settle(clauses(once.withColumnRenamed("no", "q_id")))
    if "held" not in placed.columns:
        placed = settle(gathered(placed.join(asked.select(F.explode("words").alias("term")).distinct(), "term", "left_semi")))
    scored = cover_density(clause_hits(asked, placed), weight).groupBy("q_id", "chunk_id").agg(F.sum("score").alias("score"))
    w = Window.partitionBy("q_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumnRenamed("q_id", "no")
    return questions.join(once, "question").select("q_id", "no").join(best, "no").select("q_id", "chunk_id", "score", "rank")
