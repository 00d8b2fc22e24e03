"""Quality rules by weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on statistics of the whole text. The counts of the vote patterns
(at most 3 to the number of rules) are gathered over all documents, and expectation-maximisation on them estimates for
each rule how often it votes each way on good and on bad documents, so that a rule that
often errs counts little. A document is kept when its posterior probability of being good reaches
``threshold`` and it passes two hard base rules; one bad vote may be outvoted.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import SPACE, batch, map_batches, settle, text_bytes

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
NOT_LETTERS = bytes(x for x in range(128) if x not in LETTERS + SPACE)
WINDOW = 5
#: Rules on shares abstain on texts of fewer words.
FEW = 30

STATS = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_ends", "n_bare", "n_doubles")])
STATS_DDL = ", ".join(f"{n} long" for n in STATS.names)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    code, size = ids[:n], len(seen)
    for k in range(1, window):  # exact: codes are ranked again before they could overflow
        if size * len(seen) >= 1 << 62:
            values, code = np.unique(code, return_inverse=True)
            size = len(values)
        code, size = code * len(seen) + ids[k : k + n], size * len(seen)
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """The statistics of one text in the order of STATS without doc_id; a null text has none of anything."""
    b = text or b""
    words = b.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in b.split(b"\n"):
        if line and not line.isspace() and line.strip(SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        len(b.translate(None, SPACE + CONTINUATION)),
        len(b) - len(b.translate(None, SYMBOLS)),
        dup,
        repeat_words(words),
        lines,
        len(b) - len(b.translate(None, UPPER)),
        len(b) - len(b.translate(None, LETTERS)),
        b.count(b"!"),
        sum(w[-1] in b".!?" for w in words),
        len(words) - len(b.translate(None, NOT_LETTERS).split()),  # words without a letter
        sum(map(operator.eq, words, words[1:])),
    )


def stats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of its text, one row per row of ``docs``; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_stats(t) for t in text_bytes(b.column("text"))]
            if rows:
                yield batch(STATS, doc_id=b.column("doc_id"), **dict(zip(STATS.names[1:], map(list, zip(*rows)))))

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, STATS_DDL)


def votes() -> dict[str, Column]:
    """The rules; most vote both ways. Each compares integers, so that it gives one result on every machine."""
    c = F.col
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")
    words, letters, lines = c("n_words"), c("n_letters"), c("n_lines")
    share = lambda bad, good: F.when(words < FEW, F.lit(0).cast("byte")).otherwise(vote(bad, good))
    return {
        "symbols": vote(c("n_symbols") * 20 > words, c("n_symbols") * 100 <= words),
        "word_length": share((c("word_chars") * 10 > 62 * words) | (c("word_chars") * 10 < 42 * words), c("word_chars").between(4.4 * words, 5.8 * words)),
        "duplicate_lines": vote(c("n_dup_lines") * 20 > lines, (c("n_dup_lines") == 0) & (lines >= 4)),
        "repetition": vote(c("n_repeat_words") * 100 > 8 * words, (c("n_repeat_words") * 100 <= 2 * words) & (words >= FEW)),
        "doubles": vote(c("n_doubles") * 10 > words, c("n_doubles") * 50 <= words),
        "capitals": share(c("n_upper") * 5 > letters, (c("n_upper") * 20 <= letters) & (c("n_upper") * 200 >= letters)),
        "sentences": share((c("n_ends") * 25 < words) | (c("n_ends") * 5 > words), (c("n_ends") * 100 >= 6 * words) & (c("n_ends") * 8 <= words)),
        "shouting": vote(c("n_shouts") * 20 > words, c("n_shouts") == 0),
        "letters": share(letters * 10 < 38 * words, letters * 10 >= 42 * words),
        "bare_words": vote(c("n_bare") * 10 > words, c("n_bare") * 50 <= words),
        "lines": share((lines * 100 > 12 * words) | (lines * 500 < words), lines * 100 <= 6 * words),
        "length": vote(words < 15, words >= 60),
    }


#: Before any data a rule votes -1, 0, 1 with these shares on bad and on good documents; worth PRIOR of all documents.
EXPECTED, PRIOR = ((0.30, 0.20, 0.50), (0.05, 0.25, 0.70)), 0.01


def fit(patterns: pd.DataFrame, rules: list[str], rounds: int = 1000) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Expectation-maximisation over vote patterns with column ``n`` (documents).

    Returns the patterns with ``posterior`` and, for each rule, how often it votes -1, 0 and 1 on bad and good
    documents. The first posterior comes from the balance of votes, which fixes the class called good; EXPECTED is added
    as pseudo-counts worth a share PRIOR of the documents, so that results do not hang on the size of the corpus, and
    nothing else bounds what is estimated. Abstentions do not count in the posterior.
    """
    patterns = patterns.sort_values(rules).reset_index(drop=True)
    v = patterns[rules].to_numpy(dtype=int)
    n = patterns["n"].to_numpy(dtype=float)
    up, down = (v > 0).sum(1), (v < 0).sum(1)
    good = (up + 1) / (up + 3 * down + 2)
    table = np.zeros((2, len(rules), 3))
    extra = np.array(EXPECTED) * max(PRIOR * n.sum(), 1e-9)
    for _ in range(rounds):
        prior = float(np.clip((n * good).sum() / max(n.sum(), 1e-300), 1e-6, 1 - 1e-6))
        for k, w in enumerate((n * (1 - good), n * good)):
            for j in range(len(rules)):
                table[k, j] = np.bincount(v[:, j] + 1, weights=w, minlength=3) + extra[k]
        table /= table.sum(2, keepdims=True)
        logs = (np.log(table)[:, np.arange(len(rules))[None, :], v + 1] * (v != 0)).sum(2)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - prior) / prior), -500, 500)))
        done = np.abs(new - good).max(initial=0) < 1e-10
        good = new
        if done:
            break
    patterns["posterior"] = good
    rates = pd.DataFrame([{"rule": r, "of": name} | {f"vote_{k - 1}": table[c, j, k] for k in range(3)} for c, name in ((0, "bad"), (1, "good")) for j, r in enumerate(rules)])
    return patterns, rates


def judge(docs: DataFrame, threshold: float = 0.5, rules: dict[str, Column] | None = None) -> DataFrame:
    """Every document with its statistics, votes (``vote_<rule>``), ``base_failed``, ``posterior`` and ``kept``.

    Needs ``doc_id`` and ``text``; extra columns, whatever their names, are not read. A null text counts as empty and
    fails the base rules; repeated rows are judged one by one and alike; an empty table gives an empty table. A null
    doc_id is carried through. All rows count in the estimation; only the pattern table (3 ** rules rows at most)
    reaches the driver, and it is joined back as a broadcast of that bounded size.
    """
    rules = rules or votes()
    names = [f"vote_{r}" for r in rules]
    found = settle(stats(docs))
    voted = found.select("*", *(e.alias(n) for n, e in zip(names, rules.values())))
    counts = voted.groupBy(*names).agg(F.count("*").alias("n")).toPandas()
    spark = docs.sparkSession
    if len(counts):
        fitted, _ = fit(counts, names)
        table = spark.createDataFrame(fitted[[*names, "posterior"]]).select(*(F.col(n).cast("byte").alias(n) for n in names), "posterior")
    else:
        table = voted.select(*names, F.lit(0.0).alias("posterior"))
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return (
        voted.join(F.broadcast(table), names, "left")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def drop_rejected(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that ``judge`` rejects; all columns are kept.

    A doc_id that is repeated goes if any of its rows is rejected; rows with a null doc_id can't be told apart and stay.
    """
    rejected = settle(judge(docs, threshold).where("NOT kept").select("doc_id").distinct())
    return docs.join(rejected, docs.doc_id.cast("long") == rejected.doc_id, "left_anti")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """``judge`` on the whole table ``documents``; see there for odd rows."""
    from lakeline.llm.common import read_table

    return judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )
