"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over character n-grams tells the languages
whose bit is 1 from the others: a multinomial model of byte bigrams and hashed byte trigrams, fitted from counts over
all labelled texts. A text's bit margins are compared with every codeword by a loss weighted with how well each bit
separates the training languages; the nearest codeword wins, and the gap to the second tells how sure that is.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import CHUNK_BYTES, batch, map_batches, read_table, settle, text_bytes

UNKNOWN = "und"
BIGRAMS, TRIGRAMS = 1 << 16, 1 << 16
FEATURES = BIGRAMS + TRIGRAMS
#: More learned languages than this are an error: the model is FEATURES x code bits and is shipped to every task.
MOST_LANGUAGES = 256


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """``n`` codewords of -1 and 1. Up to five languages: every split into two groups once; beyond: seeded random bits
    of length about 10 log2 n, the draw with the largest smallest distance out of 50."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(splits, dtype=float).T
    rng, best = np.random.default_rng(seed), None
    length = int(np.ceil(10 * np.log2(n)))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, length))
        if (np.abs(code.sum(0)) == n).any():
            continue
        gap = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if best is None or gap > best[0]:
            best = (gap, code)
    return best[1]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32  # all that is not a letter separates


def ngrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and hashed trigram numbers at every byte of a folded text; runs of separators are kept as they are."""
    b = _FOLD[np.frombuffer(b" " + text + b" ", dtype=np.uint8)].astype(np.int64)
    two = b[:-1] << 8 | b[1:]
    three = ((two[:-1] << 8 | b[2:]) * 0x9E3779B1 >> 12) % TRIGRAMS + BIGRAMS
    return two, three


def has_letter(text: bytes) -> bool:
    """Whether a text has a letter of any script."""
    if any(c in text for c in b"etaoinshr"):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts of bounded size; n-grams across a cut are counted with the next part."""
    for a in range(0, len(text), CHUNK_BYTES):
        yield text[max(0, a - 2) : a + CHUNK_BYTES]


COUNTS = pa.schema([("lang", pa.string()), ("feature", pa.int32()), ("n", pa.int64())])


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """``(lang, feature, n)`` over all texts; each task sums what it sees before it sends anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), text_bytes(b.column("text"))):
                own = sums.setdefault(lang, np.zeros(FEATURES, dtype=np.int64))
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
                for part in pieces(t):
                    for grams in ngrams(part):
                        if len(part) > 4096:
                            own += np.bincount(grams, minlength=FEATURES)
                        else:
                            np.add.at(own, grams, 1)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield batch(COUNTS, lang=[lang] * len(at), feature=at.astype(np.int32), n=own[at])

    part = map_batches(labelled.select(F.col("lang").cast("string"), F.col("text").cast("string")), run, "lang string, feature int, n long")
    return part.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Fitted classifiers: ``weights`` is FEATURES x bits, ``code`` languages x bits, ``trust`` one weight a bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1) and ambiguity of each row of bit margins."""
        z = np.clip(margins / self.scale, -4, 4)
        loss = (np.log1p(np.exp(-2 * z[:, None, :] * self.code[None])) * self.trust).sum(2)
        order = np.argsort(loss, axis=1, kind="stable")
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        top = np.take_along_axis(p, order[:, :1], 1)[:, 0]
        return [self.languages[i] for i in order[:, 0]], top, top < 0.6


def fit(counts: DataFrame, smooth: float = 0.5) -> Model:
    """The model from n-gram counts: at most MOST_LANGUAGES x FEATURES rows reach the driver, whatever the corpus."""
    names = sorted(r.lang for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    table = np.zeros((len(names), FEATURES))
    if names:
        rows = counts.toPandas()
        table[np.searchsorted(names, rows["lang"].to_numpy(dtype=str)), rows["feature"]] = rows["n"]
    code = codewords(len(names))
    bits = code.shape[1] if names else 0
    weights = np.zeros((FEATURES, bits), dtype=np.float32)
    share = table / np.maximum(table.sum(1, keepdims=True), 1)  # each language counts alike, however much text it has
    size = float(np.median(table.sum(1))) if names else 1.0
    for k in range(bits):
        if (code[:, k] > 0).all() or (code[:, k] < 0).all():
            continue
        sides = [(share[code[:, k] == s].mean(0) * size + smooth) for s in (1, -1)]
        weights[:, k] = np.log(sides[0] / sides[0].sum()) - np.log(sides[1] / sides[1].sum())
    mean = share @ weights  # the margin of an average text of each language
    reach = (mean * code).min(0) if names else np.zeros(0)
    scale = np.maximum(np.abs(mean).mean(0), 1e-6) if names else np.ones(0)
    trust = np.clip(reach / scale, 0.1, None) if names else np.ones(0)
    return Model(names, code, weights, scale, trust / trust.sum() * bits if bits else trust)


PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for each row of ``docs``; only the text is looked at.

    A null text, one without a letter, or a model without languages gives ``und`` with score 0. Repeated rows each get
    their row, an empty table an empty one; extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x bits floats, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = text_bytes(b.column("text"))
            known = [i for i, t in enumerate(texts) if m.languages and t and has_letter(t)]
            margins = np.zeros((len(known), m.code.shape[1]))
            for row, i in enumerate(known):
                n = 0
                for part in pieces(texts[i]):
                    for grams in ngrams(part):
                        margins[row] += m.weights[grams].sum(0, dtype=np.float64)
                        n += len(grams)
                margins[row] /= max(n, 1) / 2
            langs, scores, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            if known:
                found, score, weak = m.decode(margins)
                scores[known], unsure[known] = score, weak
                for i, lang in zip(known, found):
                    langs[i] = lang
            yield batch(PREDICTED, doc_id=b.column("doc_id"), lang_pred=langs, score=scores, ambiguous=unsure)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id):
    """Whether crc32 of the number as text leaves remainder 2 by 4; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op1_langid(spark, sf_dir: str) -> DataFrame:
    """``predict`` of the whole table ``documents`` by a model of its rows that aren't held out. A null doc_id is neither held
    out nor learnt from, a null text or language is not learnt from; other odd rows as in ``predict``."""
    docs = read_table(spark, sf_dir, "documents")
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = fit(settle(count_ngrams(train)))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
