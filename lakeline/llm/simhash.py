"""SimHash fingerprints, pigeonring search of near fingerprints, and near-duplicate removal.

A 64-bit fingerprint is cut into four segments of 16 bits on a ring. If two fingerprints differ in at most three bits,
then from some segment on every chain of consecutive segments stays within its proportional budget: no difference in
the first segment, at most one in the first two, two in three, three in all four. So a pair is looked for only where
the first segment is equal and one half of the second is equal too (24 equal bits), and the chains of two and three
segments are checked before all 64 bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import batch, components, map_batches, mix64, read_table, settle, slices, text_bytes

SEED = 42
SEGMENTS, WIDTH = 4, 16
#: Members of one bucket compared in one group; larger buckets are dealt out as pairs of blocks of this size.
BLOCK = 4096


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``size``-word shingle in order, repeats included; fewer words make one shingle."""
    words = (text or b"").lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1).tolist()
    stops = (ends - 1)[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=len(stops))


def shingle_codes(text: bytes | None, size: int) -> np.ndarray:
    """A 64-bit code of each ``size``-word shingle in order, as ``shingle_hashes`` but from the hashes of single words."""
    words = (text or b"").lower().split()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - size + 1) if words else 0
    code = own[:n].copy()
    for k in range(1, min(size, len(words))):
        code = code * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
    return mix64(code)


_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; no hashes give zero."""
    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros((8, 256), dtype=np.int64)
    for a in range(0, n, 1 << 16):
        lanes = hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8).astype(np.int64) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ _BITS) * 2 > n
    return int.from_bytes(np.packbits(bits.ravel(), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs``; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(FP, doc_id=b.column("doc_id"), fp=[signed(fingerprint(shingle_hashes(t, size))) for t in text_bytes(b.column("text"))])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def buckets(fps: DataFrame) -> DataFrame:
    """Eight rows ``(key, rep, fp)`` for each fingerprint: chain start, its segment and one half of the next segment."""
    rows = []
    for i in range(SEGMENTS):
        turned = F.col("fp") if i == 0 else F.shiftleft("fp", WIDTH * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - WIDTH * i))
        first = F.shiftrightunsigned(turned, 48)
        second = F.shiftrightunsigned(turned, 32).bitwiseAND(F.lit(0xFFFF))
        for half, part in enumerate((F.shiftright(second, 8), second.bitwiseAND(F.lit(0xFF)))):
            rows.append(F.lit((i * 2 + half) << 24).cast("long").bitwiseOR(F.shiftleft(first, 8)).bitwiseOR(part))
    return fps.select(F.explode(F.array(*rows)).alias("key"), "rep", "fp")


def within(x: np.ndarray, start: np.ndarray | int, radius: int) -> np.ndarray:
    """The pigeonring test of differences ``x``: chains of 2, 3 and 4 segments from ``start`` within their budgets."""
    by = np.uint64(WIDTH) * np.asarray(start, dtype=np.uint64)
    turned = (x << by) | np.where(by > 0, x >> ((np.uint64(64) - by) & np.uint64(63)), np.uint64(0))
    ok = np.ones(len(x), dtype=bool)
    for chain in range(1, SEGMENTS + 1):
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(turned[at] >> np.uint64(64 - WIDTH * chain)) <= chain * radius // SEGMENTS
    return ok


def group_links(rep: np.ndarray, fp: np.ndarray, start: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pigeonring test connects in one bucket: one fewer than its members at most."""
    left, us, vs = np.arange(len(fp)), [], []
    while len(left):
        seed, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), dtype=bool)
            for a in range(0, len(front), 64):
                x = (fp[front[a : a + 64], None] ^ fp[None, left]).ravel()
                hit |= within(x, start, radius).reshape(-1, len(left)).any(0)
            front, left = left[hit], left[~hit]
            us.append(np.full(len(front), rep[seed]))
            vs.append(rep[front])
    return (np.concatenate(us), np.concatenate(vs)) if us else (rep[:0], rep[:0])


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut so that rows with the same first column stay together."""
    held: list[np.ndarray] | None = None
    for b in batches:
        now = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        if cut:
            yield [x[:cut] for x in now]
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield held


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``(u, v)`` between representatives of fingerprints that connect all pairs at ``radius`` bits or fewer.

    ``fps`` has one row ``(fp, rep)`` for each distinct fingerprint. Within a bucket only a spanning forest of the
    linked members is returned, so the rows grow with the fingerprints and not with the pairs; buckets above BLOCK
    members are dealt out to tasks as pairs of blocks.
    """
    if not 0 <= radius < SEGMENTS:
        raise ValueError("radius must be 0 to 3")
    keyed = buckets(fps)
    big = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = (
        keyed.join(settle(big), "key", "left")
        .withColumn("part", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.least(x, mine) * parts + F.greatest(x, mine)))))
        .select("key", "part", "rep", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rep, fp, key in runs(batches, ["group", "rep", "fp", "key"]):
            fp = fp.view(np.uint64)
            start = key >> 25
            edge = np.flatnonzero(np.diff(group)) + 1
            first, size = np.concatenate([[0], edge]), np.diff(np.concatenate([[0], edge, [len(group)]]))
            us, vs = [], []
            small = np.repeat(size <= 8, size)
            for step in range(1, 8):  # buckets of a few members: neighbours at each distance in the sorted run
                a = np.flatnonzero(small[:-step] & (group[step:] == group[:-step]))
                if not len(a):
                    break
                a = a[within(fp[a] ^ fp[a + step], start[a], radius)]
                us.append(rep[a])
                vs.append(rep[a + step])
            for f, n in zip(first[size > 8], size[size > 8]):
                u, v = group_links(rep[f : f + n], fp[f : f + n], int(start[f]), radius)
                us.append(u)
                vs.append(v)
            if us:
                yield batch(EDGE, u=np.concatenate(us), v=np.concatenate(vs))

    grouped = dealt.withColumn("group", F.xxhash64("key", "part")).repartition("group").sortWithinPartitions("group", "rep")
    return map_batches(grouped.select("group", "rep", "fp", "key"), run, "u long, v long").distinct()


def classes(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over links, a document's own included. Null, empty and
    blank texts have fingerprint zero and are linked like any other; repeated rows each get their row; rows whose
    doc_id is null never give a component its number (null if the component has no other); an empty table gives an
    empty one; columns other than doc_id and text are not read.
    """
    marked = settle(fingerprints(docs, size))
    fps = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(fps.where("rep IS NOT NULL"), radius))
    named = fps.join(found, fps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """``classes`` on the whole table ``documents``; see there for odd rows."""
    found = classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near-duplicate removal by similarity of shingles: candidates, exact check, one document of each group.

BANDS, ROWS = 8, 3
#: In a bucket each member is paired with the smallest one and its next REACH members; so up to REACH + 2 members make all pairs.
REACH, NEAR = 3, 24
#: Members, and shingles in all, of one block of a larger bucket whose pairs are tested inside a task.
MEMBERS, SHINGLES = 1024, 1 << 20
SIGNED = pa.schema([("doc_id", pa.int64()), ("same", pa.string()), ("fp", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, same, fp, size, bands)``: a 128-bit key of the text, the SimHash of its shingles, their number and the
    keys of ``bands`` bands of ``rows`` min-hashes over all shingles."""
    seeds = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                same, fps, sizes, keys = [], [], [], []
                for t in text_bytes(b.column("text")):
                    same.append(xxhash.xxh3_128_hexdigest(t or b""))
                    h = shingle_codes(t, size)
                    fps.append(signed(fingerprint(h)))
                    sizes.append(len(h))
                    if not len(h):
                        keys.append([])
                        continue
                    least = np.empty(len(seeds), dtype=np.uint64)
                    for j, s in enumerate(seeds):
                        x = (h ^ s) * np.uint64(0xD6E8FEB86659FD93)
                        least[j] = (x ^ (x >> np.uint64(32))).min()
                    key = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        key = mix64(key ^ least[r::rows])
                    keys.append(key.view(np.int64))
                yield batch(SIGNED, doc_id=b.column("doc_id"), same=same, fp=fps, size=sizes, bands=keys)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, same string, fp long, size long, bands array<long>")


def band_pairs(keyed: DataFrame, reach: int = REACH, radius: int = NEAR) -> DataFrame:
    """Candidate pairs ``(u, v)``, u < v, of rows ``(key, doc_id, fp)`` that share a key and whose fingerprints are near.

    In a bucket each member is paired with the smallest one and with its next ``reach`` members, so that pairs grow with
    the members. That connects most groups cheaply; what it leaves apart in a larger bucket is tested by ``open_links``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        head = None
        for b in batches:
            key, doc, fp = (b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "doc_id", "fp"))
            if not len(key):
                continue
            if held is not None:
                key, doc, fp = (np.concatenate(x) for x in zip(held, (key, doc, fp)))
            carried = len(held[0]) if held is not None else 0
            edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            leader = np.repeat(edge, np.diff(np.concatenate([edge, [len(key)]])))
            lead_doc, lead_fp = doc[leader], fp[leader]
            if head is not None and head[0] == key[0]:
                same = leader == 0
                lead_doc, lead_fp = np.where(same, head[1], lead_doc), np.where(same, head[2], lead_fp)
            us, vs, xs = [lead_doc[carried:]], [doc[carried:]], [(lead_fp ^ fp)[carried:]]
            for step in range(1, reach + 1):
                a = np.flatnonzero((key[step:] == key[:-step]) & (np.arange(step, len(key)) >= carried))
                us.append(doc[a])
                vs.append(doc[a + step])
                xs.append(fp[a] ^ fp[a + step])
            u, v, x = (np.concatenate(y) for y in (us, vs, xs))
            ok = (u != v) & (np.bitwise_count(x.view(np.uint64)) <= radius)
            yield batch(EDGE, u=np.minimum(u, v)[ok], v=np.maximum(u, v)[ok])
            head = (key[-1], lead_doc[-1], lead_fp[-1])
            held = [y[-reach:] for y in (key, doc, fp)]

    dealt = keyed.repartition("key").sortWithinPartitions("key", "doc_id")
    return map_batches(dealt.select("key", "doc_id", "fp"), run, "u long, v long").distinct()


def jaccard_pairs(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs ``(u, v)`` whose sets of ``size``-word shingles have Jaccard similarity ``least`` or more, exactly."""
    a = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u"))
    b = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", "text_u", "text_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for c in batches:
            keep = []
            for s, t in zip(text_bytes(c.column("text_u")), text_bytes(c.column("text_v"))):
                sets = []
                for x in (s, t):
                    if x not in known:
                        if len(known) > 64:
                            known.clear()
                        known[x] = np.unique(shingle_codes(x, size))
                    sets.append(known[x])
                n, m = map(len, sets)
                if min(n, m) < least * max(n, m):
                    keep.append(False)
                    continue
                union = len(np.union1d(*sets))
                keep.append(n + m - union >= least * union)
            at = np.flatnonzero(keep)
            yield batch(EDGE, u=c.column("u").take(pa.array(at)), v=c.column("v").take(pa.array(at)))

    return map_batches(both, run, "u long, v long")


def forest(doc: np.ndarray, fp: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], least: float, radius: int = NEAR) -> tuple[list[int], list[int]]:
    """Links that connect all that the pairs of these documents connect which lie within ``radius`` bits and have
    similarity ``least`` or more. Documents with one ``comp`` are connected already; of two blocks (``side``) only pairs
    across are tested. Each document is compared with all that are not connected to it yet, so none is left out."""
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    codes, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(flat, np.cumsum(size)[:-1])
    label, count = np.unique(comp, return_inverse=True, return_counts=True)[1:]
    members = np.split(np.argsort(label, kind="stable"), np.cumsum(count)[:-1])
    bits, cross = fp.view(np.uint64), side.min() != side.max()
    left, mark = np.ones(len(doc), dtype=bool), np.zeros(len(codes), dtype=bool)
    us: list[int] = []
    vs: list[int] = []
    for seed in np.argsort(count, kind="stable"):  # the largest last: it is compared with what the others have left
        if not left[members[seed][0]]:
            continue
        left[members[seed]] = False
        front = members[seed].tolist()
        while front and left.any():
            x = front.pop()
            ok = left & (np.bitwise_count(bits ^ bits[x]) <= radius) & (np.minimum(size, size[x]) >= least * np.maximum(size, size[x]))
            at = np.flatnonzero(ok & (side != side[x]) if cross else ok)
            if not len(at):
                continue
            mark[ids[x]] = True
            total = np.concatenate([[0], np.cumsum(mark[np.concatenate([ids[j] for j in at])])])
            mark[ids[x]] = False
            ends = np.cumsum(size[at])
            both = total[ends] - total[ends - size[at]]
            for j in at[both >= least * (size[at] + size[x] - both)].tolist():
                if left[j]:
                    us.append(int(doc[x]))
                    vs.append(int(doc[j]))
                    left[members[label[j]]] = False
                    front += members[label[j]].tolist()
    return us, vs


def open_links(keyed: DataFrame, found: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Verified links ``(u, v)`` that connect what ``found`` (node, component) leaves apart inside a bucket.

    ``keyed`` has rows ``(key, full, doc_id, fp, size)``; all pairs of a bucket of ``full`` members or fewer were tested
    before. Larger buckets whose members are not all connected are dealt out as pairs of blocks with the texts, and
    every pair of a block that is not connected yet is tested. Only a spanning forest of verified links is returned.
    """
    named = keyed.join(found, keyed.doc_id == found.node, "left").select("key", "full", "doc_id", "fp", "size", F.coalesce("component", "doc_id").alias("comp"))
    large = named.groupBy("key", "full").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    large = settle(large.where("n > full AND low < high").select("key", F.ceil(F.greatest(F.col("n") / MEMBERS, F.col("all") / SHINGLES)).cast("int").alias("parts")))
    mine = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    dealt = settle(
        named.join(large, "key")
        .withColumn("side", mine)
        .withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, F.col("side")).alias("a"), F.greatest(x, F.col("side")).alias("b")))))
        .select(F.xxhash64("key", "part.a", "part.b").alias("group"), "doc_id", "fp", "comp", "side")
    )
    some = dealt.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("group")
    dealt = settle(dealt.join(some, "group", "left_semi"))
    own = texts.join(dealt.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def send() -> Iterator[pa.RecordBatch]:
            doc, fp, comp, side = (np.array(x, dtype=np.int64) for x in list(zip(*rows))[:4])
            u, v = forest(doc, fp, comp, side, [r[4] for r in rows], least)
            if u:
                yield batch(EDGE, u=np.minimum(u, v), v=np.maximum(u, v))

        for b in batches:
            names = ("group", "doc_id", "fp", "comp", "side")
            for g, *row, t in zip(*(b.column(n).to_pylist() for n in names), text_bytes(b.column("text"))):
                if g != now and rows:
                    yield from send()
                    rows = []
                now = g
                rows.append((*row, np.unique(shingle_codes(t, size))))
        if rows:
            yield from send()

    both = dealt.join(own, "doc_id").repartition("group").sortWithinPartitions("group")
    return map_batches(both.select("group", "doc_id", "fp", "comp", "side", "text"), run, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)`` of groups whose members are connected by shingle similarity ``least`` or more.

    Exact copies are gathered by a 128-bit key of the text first, so only different texts are compared. Candidates are
    pigeonring pairs of SimHash fingerprints (3 bits) and, since a similarity of 0.8 lets 64-bit fingerprints differ in
    up to about 20 bits, pairs that share a band of min-hashes and differ in at most 24 bits. Each pair is checked exactly
    unless other checked pairs connect its documents already: a few partners of each document first, then in every
    bucket all pairs that these leave apart. Texts without words form one group; documents with a null doc_id are returned with a null group.
    """
    copies = settle(signatures(docs, size))
    one = F.struct("doc_id", "fp", "size", "bands")
    marked = settle(copies.where("doc_id IS NOT NULL").groupBy("same").agg(F.min_by(one, "doc_id").alias("one")).select("same", "one.*"))
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    same_fp = marked.join(fps, "fp").where("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    banded = marked.select(F.explode("bands").alias("key"), "doc_id", "fp", "size")
    ring = settle(links(settle(fps)))
    home = components(ring)
    homes = marked.join(fps.join(home, fps.rep == home.node, "left").select("fp", F.coalesce("component", "rep").alias("home")), "fp")
    keyed = banded.withColumn("full", F.lit(REACH + 2)).unionByName(homes.select(F.xxhash64(F.lit("ring"), "home").alias("key"), F.lit(2).alias("full"), "doc_id", "fp", "size"))
    pairs = settle(band_pairs(banded).union(same_fp).union(ring.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct())
    involved = settle(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = plain.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    first = settle(jaccard_pairs(pairs, texts, size, least))
    found = components(first.union(open_links(keyed, components(first), plain, size, least)))
    named = marked.join(found, marked.doc_id == found.node, "left").select("same", F.coalesce("component", "doc_id").alias("component_id"))
    return copies.select("doc_id", "same").join(named, "same", "left").select("doc_id", "component_id")


def keep_one(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that with the smallest doc_id; all columns are kept.

    Repeated rows of the kept document leave one row. Rows with a null doc_id can't be told apart and stay.
    """
    groups = settle(near_duplicates(docs, size, least))
    gone = settle(groups.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(gone, docs.doc_id.cast("long") == gone.doc_id, "left_anti")
    named = groups.where("doc_id IS NOT NULL")
    if named.count() == named.distinct().count():
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))
