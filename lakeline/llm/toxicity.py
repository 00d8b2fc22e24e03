"""Toxicity by non-negative learning from confirmed toxic texts and unlabelled ones.

Only texts confirmed as toxic have a label; all training texts together are the unlabelled side, a mixture in which a
share ``prior`` is toxic. For a linear score ``g`` and the logistic loss the risk is
``prior E_p[l(g, +1)] + max(0, E_u[l(g, -1)] - prior E_p[l(g, -1)])``: the second part estimates the risk on the clean
texts of the mixture, which can't be negative; where a fitted model drives the estimate below zero the step goes the
other way for that part, so that the toxic texts inside the mixture are not learnt by heart as clean.

Features are words and beginnings of words, hashed, and weigh as ``log(1 + RATE n / (words + SMOOTH))`` in a text where
they occur ``n`` times. Those that stand out among the confirmed texts are picked from counts over all texts; texts
alike in the picked features become one row with a count. Gradients are sums of whole numbers over Spark tasks, so they
do not depend on how rows are dealt to tasks, or on retries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import batch, map_batches, mix64, read_table, settle, text_bytes
from lakeline.llm.langid import held_out
from lakeline.llm.phrases import spans

FEATURE_BITS = 22
STARTS = range(4, 9)
#: Confirmed texts used at most (those with the smallest hash of their id); their ids are sent to every task.
MOST_CONFIRMED = 200_000
#: Features of a model at most, and how far beyond chance (in standard deviations) and how often one must occur.
MOST_FEATURES, STAND_OUT, SEEN = 4096, 6.0, 3
RATE, SMOOTH = 300, 30
#: Distinct words that a task remembers, and bytes of text handled in one numpy step.
MOST_WORDS, STEP_BYTES = 1 << 18, 1 << 20
#: A model's sums are whole multiples of this.
GRAIN = 2.0**-20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of FEATURE_BITS bits for each word and its beginnings of 4 to 8 bytes, and how many each word has."""
    shift = np.uint64(64 - FEATURE_BITS)
    size = np.fromiter(map(len, words), np.int64, len(words))
    head = np.array(words, dtype="S8").view("<u8").astype(np.uint64)  # the first eight bytes, zeros behind
    grid = np.full((len(words), 1 + len(STARTS)), -1, np.int64)
    grid[:, 0] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> shift
    for j, k in enumerate(STARTS, 1):
        start = mix64((head & np.uint64((1 << 8 * k) - 1)) + np.uint64(k)) >> shift
        grid[:, j] = np.where(size > k, start.astype(np.int64), -1)
    return grid[grid >= 0], (grid >= 0).sum(1)


def groups(texts: list[bytes | None]) -> Iterator[range]:
    """Runs of texts of about STEP_BYTES together; a longer text is a run of its own."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if held and held + n > STEP_BYTES:
            yield range(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield range(begin, len(texts))


class Lexicon:
    """Features of the words that a task has met, as arrays: those of word ``i`` are ``flat[begin[i]:begin[i + 1]]``.
    With ``picked`` only those features count, by their place in it."""

    def __init__(self, picked: np.ndarray | None = None) -> None:
        self.picked = picked
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def look_up(self, tokens: list[bytes]) -> np.ndarray:
        """Numbers of the words, -1 for those without a feature."""
        known = self.number
        new = list(set(tokens).difference(known))
        if new:
            f, size = word_features(new)
            if self.picked is not None:
                at = np.minimum(np.searchsorted(self.picked, f), len(self.picked) - 1)
                good = self.picked[at] == f
                f, size = at[good], np.bincount(np.repeat(np.arange(len(new)), size)[good], minlength=len(new))
            some = size > 0
            number = np.where(some, len(self.begin) - 2 + np.cumsum(some), -1)
            known.update(zip(new, number.tolist()))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size[some])])
            self.flat = np.concatenate([self.flat, f])
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def expand(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All features of the words, and the place in ``words`` that each comes from."""
        size = self.begin[words + 1] - self.begin[words]
        place = np.repeat(np.arange(len(words)), size)
        return self.flat[np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[words], size)], place

    def counts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(text, feature, n)`` in order, how often each feature occurs in each whole text, and the words of each text."""
        words = np.zeros(len(texts), np.int64)
        keys, many = [], []
        for run in groups(texts):
            if len(self.number) > MOST_WORDS:
                self.forget()
            for tokens, owner in self.tokens(texts, run):
                words += np.bincount(owner, minlength=len(texts))
                ids = self.look_up(tokens)
                own = np.flatnonzero(ids >= 0)
                pair, n = np.unique(owner[own] << 32 | ids[own], return_counts=True)
                f, place = self.expand(pair & 0xFFFFFFFF)
                key, back = np.unique((pair[place] >> 32) << FEATURE_BITS | f, return_inverse=True)
                keys.append(key)
                many.append(np.bincount(back, n[place], minlength=len(key)).astype(np.int64))
        key, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, many))
        if len(keys) > 1 and (np.diff(key) <= 0).any():  # a text in several parts
            key, back = np.unique(key, return_inverse=True)
            n = np.bincount(back, n, minlength=len(key)).astype(np.int64)
        return key >> FEATURE_BITS, key & ((1 << FEATURE_BITS) - 1), n, words

    @staticmethod
    def tokens(texts: list[bytes | None], run: range) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """The words of a run of texts with their text's number; a longer text comes in parts."""
        if len(run) == 1:
            for part in spans((texts[run[0]] or b"").translate(_FOLD)):
                tokens = part.split()
                yield tokens, np.full(len(tokens), run[0], np.int64)
            return
        held, sizes = [], []
        for i in run:
            tokens = (texts[i] or b"").translate(_FOLD).split()
            held += tokens
            sizes.append(len(tokens))
        yield held, np.repeat(np.arange(run.start, run.stop), sizes)


def weights_of(n: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(RATE * n / (words + SMOOTH))


FOUND = pa.schema([("feature", pa.int64()), ("confirmed", pa.int64()), ("all", pa.int64())])


def pick(train: DataFrame) -> np.ndarray:
    """Sorted numbers of at most MOST_FEATURES features that stand out among the confirmed of ``train(text, toxic)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, lexicon = np.zeros((2, 1 << FEATURE_BITS), np.int32), Lexicon()
        texts = np.zeros(2, np.int64)
        for b in batches:
            toxic = np.asarray(b.column("toxic"))
            texts += [toxic.sum(), len(toxic)]
            row, f, _, _ = lexicon.counts(text_bytes(b.column("text")))
            np.add.at(seen[1], f, 1)
            np.add.at(seen[0], f[toxic[row] == 1], 1)
        at = np.flatnonzero(seen[1])
        yield batch(FOUND, feature=np.append(at, -1), confirmed=np.append(seen[0, at], texts[0]).astype(np.int64), all=np.append(seen[1, at], texts[1]).astype(np.int64))

    found = map_batches(train, run, "feature long, confirmed long, all long").groupBy("feature").agg(F.sum("confirmed").alias("p"), F.sum("all").alias("u"))
    found = settle(found.where(f"p >= {SEEN} or feature = -1"))
    total = found.where("feature = -1").first()
    if total is None or not total.p:
        return np.zeros(0, np.int64)
    share = F.col("u") / total.u
    beyond = (F.col("p") / total.p - share) / F.sqrt(share * (1 - share) / total.p + 1e-12)
    rows = found.where("feature >= 0").select("feature", beyond.alias("z")).where(F.col("z") > STAND_OUT).orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).collect()
    return np.array(sorted(r.feature for r in rows), np.int64)


PATTERN = pa.schema([("toxic", pa.int32()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])


def patterns(train: DataFrame, picked: np.ndarray) -> DataFrame:
    """``(toxic, at, x, n)``: texts alike in the picked features; ``x`` is rounded to tenths."""
    shared = train.sparkSession.sparkContext.broadcast(picked)  # MOST_FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for b in batches:
            row, f, n, words = lexicon.counts(text_bytes(b.column("text")))
            x = np.round(weights_of(n, words[row]), 1).astype(np.float32)
            ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            yield batch(PATTERN, toxic=b.column("toxic"), at=pa.ListArray.from_arrays(ends, pa.array(f.astype(np.int32))), x=pa.ListArray.from_arrays(ends, pa.array(x)))

    return settle(map_batches(train, run, "toxic int, at array<int>, x array<float>").groupBy("toxic", "at", "x").agg(F.count("*").alias("n")))


@dataclass
class Model:
    """``weights`` of the sorted ``features`` and ``bias``; without confirmed texts no features and score 0."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


SUMS = pa.schema([("side", pa.int32()), ("i", pa.int32()), ("v", pa.int64())])
POSITIVE, NEGATIVE, MIXED = 0, 1, 2


def gradients(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """Sums over all rows for weights ``w`` (bias last): gradients of the confirmed texts' losses as toxic and as clean
    and of the mixture's as clean; then the value of the loss, then the number of texts. 3 x (features + 3)."""
    shared = rows.sparkSession.sparkContext.broadcast(w)  # MOST_FEATURES + 1 numbers
    size = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, out = shared.value, np.zeros((3, size + 2))
        for b in batches:
            at, x = np.asarray(b.column("at").flatten(), dtype=np.int64), np.asarray(b.column("x").flatten(), dtype=np.float64)
            n, toxic = np.asarray(b.column("n")), np.asarray(b.column("toxic"))
            row = np.repeat(np.arange(len(n)), np.diff(np.asarray(b.column("at").offsets)))
            g = np.bincount(row, w[at] * x, minlength=len(n)) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            for side, slope, loss, of in ((POSITIVE, p - 1, np.logaddexp(0, -g), n * toxic), (NEGATIVE, p, np.logaddexp(0, g), n * toxic), (MIXED, p, np.logaddexp(0, g), n)):
                whole = lambda v: np.rint(v / GRAIN)
                out[side, : size - 1] += np.bincount(at, whole(slope[row] * x) * of[row], minlength=size - 1)
                out[side, size - 1] += (whole(slope) * of).sum()
                out[side, size] += (whole(loss) * of).sum()
                out[side, size + 1] += of.sum()
        side, i = np.nonzero(out)
        yield batch(SUMS, side=side.astype(np.int32), i=i.astype(np.int32), v=out[side, i].astype(np.int64))

    out = np.zeros((3, size + 2))
    for r in map_batches(rows, run, "side int, i int, v long").groupBy("side", "i").agg(F.sum("v").alias("v")).collect():
        out[r.side, r.i] = r.v * (1 if r.i == size + 1 else GRAIN)
    return out


def fit(train: DataFrame, prior: float, rounds: int = 30, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """The model from ``train(text, toxic)``, where ``toxic`` is 1 for confirmed texts and 0 says nothing."""
    picked = pick(train) if prior > 0 else np.zeros(0, np.int64)
    if not len(picked):
        return Model(picked, np.zeros(0), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -np.inf if prior <= 0 else np.inf)
    prior = min(prior, 1 - 1e-6)
    rows = patterns(train, picked)
    w = np.append(np.zeros(len(picked)), np.log(prior / (1 - prior)))
    speed, spread = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, rounds + 1):
        sums = gradients(rows, w)
        mean = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
        clean_risk = mean[MIXED, -1] - prior * mean[NEGATIVE, -1]
        rest = mean[MIXED, :-1] - prior * mean[NEGATIVE, :-1]
        step = (prior * mean[POSITIVE, :-1] + rest if clean_risk >= 0 else -rest) + decay * np.append(w[:-1], 0)
        speed, spread = 0.9 * speed + 0.1 * step, 0.999 * spread + 0.001 * step**2
        w = w - rate * (speed / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.999**t)) + 1e-8)
    return Model(picked, w[:-1], float(w[-1]))


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``; only the text is looked at, whole. A null or empty text has the
    model's base score, repeated rows each get theirs, an empty table gives an empty one, other columns aren't read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lexicon = Lexicon(m.features)
        for b in batches:
            g = np.full(b.num_rows, m.bias)
            if len(m.features):
                row, f, n, words = lexicon.counts(text_bytes(b.column("text")))
                g += np.bincount(row, m.weights[f] * weights_of(n, words[row]), minlength=b.num_rows)
            with np.errstate(over="ignore"):
                yield batch(SCORED, doc_id=b.column("doc_id"), score=1 / (1 + np.exp(-g)))

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")


def learn(docs: DataFrame, labels: DataFrame, rounds: int = 30) -> Model:
    """The model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``. A doc_id is confirmed if any of its labels
    is 1; the prior is the share of confirmed ones among all labelled. Rows with a null id or label are no labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = settle(known)
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    confirmed = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_CONFIRMED).select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    train = texts.join(F.broadcast(settle(confirmed)), "doc_id", "left").select("text", F.coalesce("toxic", F.lit(0)).alias("toxic"))  # MOST_CONFIRMED ids
    return fit(train, prior, rounds)


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """``score`` of the whole table ``documents`` by a model of its rows and labels that aren't held out. Null ids are
    neither held out nor learnt from; other odd rows as in ``score`` and ``learn``."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    train = ~held_out(F.col("doc_id"))
    model = learn(docs.where(train), labels.where(train))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
