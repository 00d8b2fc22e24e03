"""Best-fit packing of tokenised documents into sequences, with bounds that certify the number of sequences.

Pieces are dealt out at random to partitions of a bounded number of rows; each runs best-fit decreasing. Dual-feasible
functions of the piece lengths bound the number of sequences of each partition, and of all pieces, from below. A
partition whose sequences equal its bound is certified and rests; partitions with gaps exchange the pieces of their
not-full sequences, which are dealt out again and packed by best-fit decreasing once more. Where all are certified, or
exchanging among them saves nothing, but the sequences are still more than the bound for all pieces, the not-full
sequences of every partition are exchanged. This ends when that bound is met or an exchange saves nothing.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import batch, map_batches, read_table, settle, slices, text_bytes

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Pieces that one partition packs; lengths and references only, about 50 bytes each.
PART_ROWS = 50_000
#: Runs of letters or signs whose ids a Python worker remembers; beyond, it forgets the rarer ones, which changes no result.
MEMO_WORDS = 150_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of white-space separated words, each distinct word of a batch looked up once.

    Serves tokenizers that drop white space, lower-case, and tokenise runs of letters, digits, runs of other signs and
    a few English endings each by itself, such as the default one. Words of common letters, digits and signs are cut
    into such runs, whose ids are remembered; all other words are tokenised as they are.
    """

    SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    #: Letters that no normalisation changes but for case.
    LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f\u0410-\u044f"
    PLAIN, SIMPLE = re.compile(f"[{LETTERS}]+"), re.compile(f"[{LETTERS}0-9{re.escape(SIGNS)}]+")
    RUNS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
    SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")  # white space beyond ASCII
    END_MARK, NOTHING = 0, 1  # codes of id 0 and of no ids at all

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that end a run
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {"": self.NOTHING}
        self.flat, self.count = np.zeros(1, dtype=np.uint32), np.array([1, 0], dtype=np.int64)
        self.uses = np.zeros(2, dtype=np.int64)

    def put(self, words: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        self.codes.update(zip(words, range(len(self.count), len(self.count) + len(words))))
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        self.count = np.concatenate([self.count, count])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), dtype=np.int64)])

    def tokenise(self, words: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order and their numbers; ``joined``: words of plain letters, whose last tokens are told by their end."""
        if joined:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.int64)
            at = np.flatnonzero(self.ends[ids])
            if len(at) == len(words):
                return ids, np.diff(at, prepend=-1)
        own = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in own for i in x], dtype=np.int64), np.array([len(x) for x in own], dtype=np.int64)

    def add(self, words: list[str]) -> None:
        """Learn the ids of words that are not known yet."""
        plain = [self.PLAIN.fullmatch(w) is not None for w in words]
        for joined in (True, False):
            some = [w for w, p in zip(words, plain) if p == joined]
            parts = [(own, *self.tokenise(own, joined)) for own in (some[a : a + 1000] for a in range(0, len(some), 1000))]
            if parts:
                self.put(some, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))

    def forget(self) -> None:
        """Keep the runs used most since the last time, half of MEMO_WORDS at most."""
        least = max(2, int(np.partition(self.uses, -(MEMO_WORDS // 2))[-(MEMO_WORDS // 2)]) + 1) if len(self.uses) > MEMO_WORDS // 2 else 0
        kept = [(w, c) for w, c in self.codes.items() if self.uses[c] >= least and c != self.NOTHING]
        codes = np.array([c for _, c in kept], dtype=np.int64)
        flat, count = gather(self.flat, np.cumsum(self.count) - self.count, self.count, codes), self.count[codes]
        self.clear()
        self.put([w for w, _ in kept], flat, count)

    def lookup(self, words: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.codes.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
        lost = np.flatnonzero(codes < 0).tolist()
        if lost:
            self.add(list(dict.fromkeys(words[i] for i in lost)))
            codes[lost] = [self.codes[words[i]] for i in lost]
        return codes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, an end mark behind each, and the number of ids of each text."""
        if len(self.codes) > MEMO_WORDS:
            self.forget()
        lower = [t if t is None or b"<|" in t else t.lower() for t in text_bytes(texts)]  # special tokens are told by case
        lists = pc.ascii_split_whitespace(pa.array(lower, type=pa.large_binary()).view(pa.large_string()))
        per = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        runs: list[str] = []
        upto = [0]
        for w in coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist():
            w = w.decode("utf-8", "replace")
            stem = w.rstrip(self.SIGNS)
            if self.PLAIN.fullmatch(stem):
                runs.append(stem)
                if len(stem) < len(w):
                    runs.append(w[len(stem) :])
            else:
                for part in (w,) if w.isascii() else self.SPACES.split(w):
                    if self.SIMPLE.fullmatch(part) and "<|" not in part:
                        runs += self.RUNS.findall(part.lower())
                    else:
                        runs.append(part)
            upto.append(len(runs))
        codes = self.lookup(runs)
        words = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(per), len(upto) - 1)
        upto = np.array([*upto, len(runs) + 1])
        often = np.repeat(np.bincount(words, minlength=len(upto) - 1)[:-1], np.diff(upto)[:-1])
        self.uses += np.bincount(codes, weights=often, minlength=len(self.uses)).astype(np.int64)
        codes = np.append(codes, self.END_MARK)
        count = np.diff(np.concatenate([[0], np.cumsum(self.count[codes])])[upto])
        flat = gather(self.flat, np.cumsum(self.count) - self.count, self.count, codes)
        ids = gather(flat, np.cumsum(count) - count, count, words).astype("<u4")
        return ids, np.diff(np.cumsum(count[words])[np.cumsum(per) + np.arange(len(per))], prepend=0)


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches ``flat[start : start + count]`` of the codes, one behind the other."""
    n = count[codes]
    upto = np.cumsum(n)
    at = np.repeat((start[codes] - (upto - n)).astype(np.int32), n)  # a slice of texts has far fewer ids
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; threads would each keep memory
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise every text, add an end mark (id 0) and cut what is longer than ``capacity`` into pieces of it."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                ids, sizes = enc.encode(b.column("text"))
                rows: list[tuple] = []
                at = 0
                for d, n in zip(b.column("doc_id").to_pylist(), sizes.tolist()):
                    for k, s in enumerate(range(0, n, capacity)):
                        own = ids[at + s : at + min(n, s + capacity)]
                        rows.append((d, k, s, len(own), zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None))
                    at += n
                yield batch(PIECES, **dict(zip(PIECES.names, map(list, zip(*rows)))))
        if len(enc.codes) > MEMO_WORDS // 2:  # a worker keeps its memory after the last task
            enc.forget()

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES_DDL)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin; the fullest bin that still fits is found by bit search."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    for i in order.tolist():
        n = int(lengths[i])
        free = mask >> n
        if free:
            r = n + (free & -free).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            k, r = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = k, fill[k]
        fill[k] += n
        r -= n
        if r:
            if not room[r]:
                mask |= 1 << r
            room[r].append(k)
    return bins, offsets, np.array(fill, dtype=np.int64)


def tighten(lengths: np.ndarray, capacity: int, among: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``best_fit_decreasing``, but each bin takes the largest item left and the best-filling subset of others.

    The subset comes from reachable sums held as bits of an integer, over at most ``among`` items spread evenly over
    those that fit; all items are packed whatever ``among`` is.
    """
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    bins, offsets, fill = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64), []
    left = np.arange(len(size))
    while len(left):
        take, room = [left[0]], capacity - int(size[left[0]])
        rest = left[1:]
        fits = rest[size[rest] <= room]
        if len(fits) > among:
            fits = fits[np.linspace(0, len(fits) - 1, among).astype(int)]
        sums, most = [1], (1 << (room + 1)) - 1
        for n in size[fits].tolist():
            sums.append((sums[-1] | sums[-1] << n) & most)
            if sums[-1] >> room:
                break
        at = sums[-1].bit_length() - 1
        for j in range(len(sums) - 1, 0, -1):
            if not sums[j - 1] >> at & 1:
                take.append(fits[j - 1])
                at -= int(size[fits[j - 1]])
        own = size[take]
        bins[order[take]] = len(fill)
        offsets[order[take]] = np.cumsum(own) - own
        fill.append(int(own.sum()))
        left = np.setdiff1d(left, take, assume_unique=True)
    return bins, offsets, np.array(fill, dtype=np.int64)


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best-fit decreasing; if it misses the bound, the items of its not-full bins are packed once more."""
    bins, offsets, fill = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    if len(fill) > bound:
        open_bins = np.flatnonzero(fill < capacity)
        again = np.flatnonzero(fill[bins] < capacity)
        new, place, own = tighten(lengths[again], capacity)
        if len(own) < len(open_bins):
            shut = np.flatnonzero(fill == capacity)
            number = np.zeros(len(fill), dtype=np.int64)
            number[shut] = np.arange(len(shut))
            bins = number[bins]
            bins[again], offsets[again] = new + len(shut), place
            fill = np.concatenate([fill[shut], own])
    return bins, offsets, fill, bound


def lower_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """No packing uses fewer bins: the best of dual-feasible functions, in exact integers.

    U_e drops items below e and counts those above capacity - e as whole bins; V_k rounds (k + 1) x / capacity down to
    k-ths unless it is whole; their compositions are dual feasible too. ``times`` says how often each length occurs.
    """
    if not len(lengths):
        return 0
    count = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(count, lengths, 1 if times is None else times)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    steps = np.unique(np.concatenate([[0], lengths[lengths <= capacity // 2]]))
    if len(steps) > 64:  # any choice gives a valid bound
        steps = steps[np.linspace(0, len(steps) - 1, 64).astype(int)]
    for e in steps.tolist():
        u = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int((u * count).sum()) // capacity))
        for k in range(1, 9):
            up = (k + 1) * u
            v = np.where(up % capacity == 0, k * u, up // capacity * capacity)  # in units of 1 / k
            best = max(best, -(-int((v * count).sum()) // (k * capacity)))
    return best


PACKED_DDL = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, part long, bin long, offset long, fill long, bins long, bound long"


def pack_parts(rows: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """One best-fit round: deal ``rows`` to ``parts`` partitions and pack each; ``bins`` and ``bound`` are the partition's."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, fill, bound = pack_lengths(lengths, capacity)
        for name, values in (("bin", bins), ("offset", offsets), ("fill", fill[bins]), ("bins", np.full(len(bins), len(fill))), ("bound", np.full(len(bins), bound))):
            table = table.append_column(name, pa.array(values, type=pa.int64()))
        return table

    dealt = rows.select("rid", "doc_id", "piece", "start", "length", "ids_crc32", "ids", F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInArrow(run, PACKED_DDL).withColumn("turn", F.lit(turn))


def numbered(packed: DataFrame, out: list[str]) -> DataFrame:
    return packed.withColumn("sequence_id", F.shiftleft(F.col("turn").cast("long"), 44) + F.shiftleft("part", 20) + F.col("bin")).select(out)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, part_rows: int = PART_ROWS, rounds: int | None = None) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``; sequences hold at most ``capacity`` tokens.

    A null text counts as empty and gives a piece of its end mark alone. Repeated rows are packed one by one; a null
    doc_id is carried through; an empty table gives an empty one; columns other than doc_id and text are not read.
    ``with_ids`` adds the token ids of each piece. Sequence numbers are unique but not dense (for ``part_rows`` of
    some hundred thousand at most). Exchanges go on until the bound of all pieces is met, all that is left fits one
    partition, or one needs no fewer sequences, which is not taken; full sequences stay, so what is left shrinks.
    ``rounds`` ends them earlier.
    """
    cut = settle(pieces(docs, capacity, path, with_ids).withColumn("rid", F.monotonically_increasing_id()))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset"]
    done = [cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("rid")).withColumn("offset", F.lit(0).cast("long")).select(out)]
    left = cut.where(F.col("length") < capacity)
    sizes = left.groupBy("length").agg(F.count("*").alias("n")).toPandas()  # capacity rows at most
    least = lower_bound(sizes["length"].to_numpy(np.int64), capacity, sizes["n"].to_numpy(np.int64))
    is_full, parts, loose, sealed, only_gaps = F.col("fill") == capacity, 1, None, 0, True

    def census(rows: DataFrame) -> tuple[int, int]:
        return tuple(rows.agg(F.count_distinct("turn", "part", "bin"), F.count("*")).first())

    for turn in range(0 if not len(sizes) else 2**19 if rounds is None else rounds + 1):  # each turn needs fewer sequences
        if loose is None:
            some, rest, before, m = left, None, None, int(sizes["n"].sum())
        else:
            before, m = census(loose)
            if sealed + before <= least:
                break
            some, rest = loose, None
            gaps = loose.where("bins > bound")
            own = census(gaps)
            if only_gaps and 0 < own[1] < m:  # the other partitions are certified: no packing of theirs has fewer
                some, rest, before, m = gaps, loose.where("bins = bound"), *own
            elif parts == 1:
                break
        parts = max(1, -(-m // part_rows))
        new = settle(pack_parts(some, parts, turn, capacity))
        if before is not None and census(new)[0] >= before:  # saved nothing: what was exchanged stays as it was
            if rest is None:
                break
            only_gaps, parts = False, 2
            continue
        sealed, only_gaps = sealed + census(new.where(is_full))[0], True
        done.append(numbered(new.where(is_full), out))
        loose = new.where(~is_full) if rest is None else rest.unionByName(new.where(~is_full))
        if rest is not None:
            parts = 2
    if loose is not None:
        done.append(numbered(loose, out))
    result = done[0]
    for x in done[1:]:
        result = result.unionByName(x)
    return result


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """``pack`` on the whole table ``documents``; see there for odd rows."""
    return pack(read_table(spark, sf_dir, "documents"))
