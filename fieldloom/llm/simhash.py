"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced Hamming comparison.

Fingerprints are split into ``radius + 2`` blocks; two fingerprints within the radius agree on at least two
blocks, so a row goes to one bucket for each pair of blocks.  Inside a bucket the bits stand vertically (one
packed plane for each bit position) and all pairs at one lag of the sorted bucket are compared at once: the
XORed planes are added into carry-save counters, and a lag is abandoned when every pair in it has exceeded the
radius.  A bucket emits a spanning forest of its links, never all pairs; one with very many members is dealt into parts that
meet two by two, so that no task holds it whole.

similar() and keep_one() compare sets of five-word shingles for a similarity: longer fingerprints find who may be near, and
the sets decide; see there.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other;
repeated rows share a component; a null doc_id never names a component; no rows give no rows; further columns of
the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import columns_of, connected_components, cut, tidy

BITS = 64


def fingerprint(text: bytes, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, over all of its shingles with repeats."""
    import xxhash

    words, k = text.lower().split(), words_per_shingle
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < k:
        hashes = [digest(line, seed)]
    else:
        at = [n + i for i, n in enumerate(accumulate(map(len, words), initial=0))]
        hashes = [digest(line[a : b - 1], seed) for a, b in zip(at, at[k:], strict=False)]
    ones = np.zeros(BITS, np.int64)
    every = np.array(hashes, "<u8")
    for part in range(0, len(every), 16384):
        rows = every[part : part + 16384].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(every), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t.as_py() or "").encode(), words_per_shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, fp long")


def bucket_keys(fp: str, radius: int) -> list[Column]:
    """One long for each pair of blocks: the pair's number above the blocks' bits."""
    cuts = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]

    def block(i: int) -> Column:
        return F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))

    keys = []
    for n, (i, j) in enumerate(combinations(range(radius + 2), 2)):
        width = cuts[j + 1] - cuts[j]
        keys.append(F.shiftleft(block(i), width).bitwiseOR(block(j)).bitwiseOR(F.lit(n << 52)))
    return keys


def within(planes: list[np.ndarray], live: np.ndarray, radius: int) -> np.ndarray:
    """Packed flags of the pairs whose planes hold at most radius ones; live marks the pairs that count.

    Carry-save counters of just enough digits, and a sticky overflow.  Work stops when no live pair is left.
    """
    digits = max(1, (radius + 1).bit_length() - (radius & (radius + 1) == 0))
    count = [np.zeros_like(live) for _ in range(digits)]
    over = ~live
    for n, plane in enumerate(planes):
        carry = plane
        for d in range(digits):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        if n % 8 == 7 and over.all() and (over == 255).all():
            return np.zeros_like(live)
    above = np.zeros_like(live)  # count > radius, from the lowest digit up
    for d in range(digits):
        above = (count[d] & above) | ((count[d] | above) if not radius >> d & 1 else 0)
    return ~over & ~above


def close(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, Iterator[tuple[np.ndarray, int]]]]:
    """(rows, their pairs) of rows sorted by key; the pairs are (places in rows, lag) that share a key and lie within the radius."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    power = np.frexp(lengths)[1]  # runs of like length go together, so that few lags are wasted

    def pairs(k: np.ndarray, f: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, int]]:
        bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
        shifted: dict[int, np.ndarray] = {r: np.packbits(bits[:, r:], axis=1) for r in range(8)}
        del bits
        for lag in range(1, longest):
            same = k[lag:] == k[:-lag]
            live = np.packbits(same)
            q, r = divmod(lag, 8)
            n = len(live)
            near = within([shifted[0][b, :n] ^ shifted[r][b, q : q + n] for b in range(BITS)], live, radius)
            hit = np.flatnonzero(np.unpackbits(near, count=len(same)))
            if len(hit):
                yield hit, lag

    for p in np.unique(power[lengths > 1]):
        rows = np.flatnonzero(np.repeat(power, lengths) == p)
        yield rows, pairs(keys[rows], fps[rows], int(lengths[power == p].max()))


class Trees:
    """Union-find of which find() is one look after settle()."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        parent = self.parent
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
        return a != b

    def settle(self) -> None:
        while (self.parent != self.parent[self.parent]).any():
            self.parent = self.parent[self.parent]

    def apart(self, at: np.ndarray, lag: int) -> np.ndarray:
        return at[self.parent[at] != self.parent[at + lag]]


def forest(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (src, dst) of fingerprints that span the pairs within the radius among distinct rows sorted by key."""
    src, dst = [fps[:0]], [fps[:0]]
    for rows, pairs in close(keys, fps, radius):
        trees = Trees(len(rows))
        for hit, lag in pairs:
            for i in trees.apart(hit, lag).tolist():
                trees.join(i, i + lag)
            trees.settle()
        linked = np.flatnonzero(trees.parent != np.arange(len(rows)))
        src.append(fps[rows[linked]])
        dst.append(fps[rows[trees.parent[linked]]])
    return np.concatenate(src), np.concatenate(dst)


def spread(keyed: DataFrame, member: str, most: int) -> DataFrame:
    """keyed (k, member, ...) with a column q, so that any two rows of one k have a q in common, and no q has over about 2 * most rows.

    A key with more rows is dealt into parts by a digest of the member, and each two parts meet under a q of their own.
    """
    hot = keyed.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > most).select("k", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    dealt = keyed.join(hot, "k", "left").withColumn("part", F.pmod(F.xxhash64(F.lit(7), F.col(member)), F.coalesce("parts", F.lit(1))).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("k", F.least("part", j), F.greatest("part", j)))
    return dealt.withColumn("q", F.explode(F.when(F.col("parts").isNull(), F.array("k")).otherwise(meets))).drop("parts", "part")


def links(distinct: DataFrame, radius: int = 3, most: int = 4096) -> DataFrame:
    """(src, dst) among distinct fp values: enough links to connect all that lie within the radius of each other."""
    keyed = spread(distinct.select(F.explode(F.array(*bucket_keys("fp", radius))).alias("k"), "fp"), "fp", most)
    keyed = keyed.select("q", "fp").repartition("q").sortWithinPartitions("q", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, f in whole_keys(batches, 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(k, f.to_numpy(), radius)], ["src", "dst"])

    return keyed.mapInArrow(run, "src long, dst long")


def whole_keys(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple]:
    """(first column in NumPy, the others in Arrow) of rows sorted by the first column, cut between keys about every so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if held[0].column(0)[0] == batch.column(0)[-1] or sum(x.num_rows for x in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(0).to_numpy()
        end = int(np.searchsorted(keys, keys[-1]))
        held = table.slice(end).to_batches()
        yield keys[:end], *(c.slice(0, end).combine_chunks() for c in table.columns[1:])
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table.column(0).to_numpy(), *(c.combine_chunks() for c in table.columns[1:])


def components(docs: DataFrame, radius: int = 3, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, its own included."""
    prints = cut(fingerprints(docs, words_per_shingle), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    label = connected_components(links(distinct.select("fp"), radius))
    named = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    named = named.select("fp", "label").join(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "label")
    return prints.join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


WORDS, WIDE_WORDS, KEYS, SIMILARITY = 5, 8, 8, 0.8
STEPS = np.array([(0x9E3779B97F4A7C15 * i) & (2**64 - 1) for i in range(16)], np.uint64)
NO_KEY = np.iinfo(np.int64).max


def radii(similarity: float, wide_words: int = WIDE_WORDS) -> tuple[int, int]:
    """Radii over the first 64 bits and over all that pairs of a similarity keep within, but for one in a thousand or two.

    Sets of equal size and Jaccard similarity j have cosine 2 j / (1 + j); each bit differs with probability
    arccos(cosine) / pi.  Both radii leave over three deviations more: they are filters, the sets decide.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return tuple(math.ceil(n * share + 3.3 * math.sqrt(n * share * (1 - share))) for n in (BITS, BITS * wide_words))


def shingle_hashes(text: bytes, words_per_shingle: int) -> np.ndarray:
    """Hashes of the set of shingles; a text of fewer words is one shingle, whatever their number."""
    import xxhash

    words, k = text.lower().split(), words_per_shingle
    line = b" ".join(words)
    at = [n + i for i, n in enumerate(accumulate(map(len, words), initial=0))]
    shingles = {line[a : b - 1] for a, b in zip(at, at[k:], strict=False)} if len(words) > k else {line}
    return np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64, len(shingles))


def sketch(h: np.ndarray, wide_words: int, keys: int) -> tuple[int, int, bytes, list[int]]:
    """(two digests of a set of shingle hashes, its long SimHash, its smallest hashes)."""
    ones = np.zeros(BITS * wide_words, np.int64)
    with np.errstate(over="ignore"):
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        for part in range(0, len(h), 4096):
            rows = h[part : part + 4096, None] + STEPS[None, :wide_words]
            rows = (rows ^ (rows >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
            rows ^= rows >> np.uint64(31)
            ones += np.add.reduce(np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
        low = np.partition(mixed, keys)[:keys] if len(mixed) > keys else mixed
        first, second = int(h.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mixed))
    return first, second, np.packbits(2 * ones > len(h), bitorder="little").tobytes(), np.sort(low.view(np.int64)).tolist()


def wide_prints(prints: pa.Array, wide_words: int) -> np.ndarray:
    return np.frombuffer(b"".join(prints.to_pylist()), "<u8").reshape(len(prints), wide_words)


def marked(groups: np.ndarray, keys: np.ndarray, wide: np.ndarray, lows: np.ndarray, short: int, long: int) -> np.ndarray:
    """Rows that have another one within both radii in their group; a pair counts under the smallest key it shares."""
    out = np.zeros(len(keys), bool)
    for rows, pairs in close(groups, wide[:, 0].view(np.int64).copy(), short):
        own, bits, low, found = keys[rows], wide[rows], lows[rows], np.zeros(len(rows), bool)
        for every, lag in pairs:
            for part in range(0, len(every), 50_000):
                at = every[part : part + 50_000]
                at = at[~(found[at] & found[at + lag])]
                at = at[np.bitwise_count(bits[at] ^ bits[at + lag]).sum(axis=1) <= long]
                shared = (low[at][:, :, None] == low[at + lag][:, None, :]).any(axis=2)
                at = at[np.where(shared, low[at], NO_KEY).min(axis=1) == own[at]]
                found[at] = found[at + lag] = True
        out[rows[found]] = True
    return out


def same_sets(keys: np.ndarray, names: np.ndarray, wide: np.ndarray, sets: list[np.ndarray], short: int, long: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (src, dst) of names that span the pairs under one key within both radii whose sets have the similarity."""
    src, dst = [names[:0]], [names[:0]]
    for rows, pairs in close(keys, wide[:, 0].view(np.int64).copy(), short):
        bits, trees = wide[rows], Trees(len(rows))
        for every, lag in pairs:
            at = trees.apart(every, lag)
            at = at[np.bitwise_count(bits[at] ^ bits[at + lag]).sum(axis=1) <= long]
            for i in at.tolist():
                a, b = sets[rows[i]], sets[rows[i + lag]]
                if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    continue
                common = len(np.intersect1d(a, b, assume_unique=True))
                if common >= similarity * (len(a) + len(b) - common):
                    trees.join(i, i + lag)
            trees.settle()
        linked = np.flatnonzero(trees.parent != np.arange(len(rows)))
        src.append(names[rows[linked]])
        dst.append(names[rows[trees.parent[linked]]])
    return np.concatenate(src), np.concatenate(dst)


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, text): rows of one id and text have one name (doc_id, t1, t2)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def set_groups(docs: DataFrame, similarity: float, words_per_shingle: int, wide_words: int, keys: int, most: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(rows seen: doc_id, t1, t2, set_a, set_b; sets: set_a, set_b, first, label).

    first: (no id, doc_id, t1, t2) of the set's first row.  Sets of one label are linked by similar ones.
    """
    short, long = radii(similarity, wide_words)
    schema = "doc_id long, t1 long, t2 long, set_a long, set_b long, fp binary, keys array<long>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(shingle_hashes(t.as_py().encode(), words_per_shingle), wide_words, keys) for t in batch.column(3)]
            first, second, prints, lows = zip(*found, strict=True) if found else ((), (), (), ())
            digests = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (first, second)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *digests, pa.array(prints, pa.binary()), pa.array(lows, pa.list_(pa.int64()))], ["doc_id", "t1", "t2", "set_a", "set_b", "fp", "keys"])

    seen = cut(named(docs).mapInArrow(tidy(read), schema), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")).alias("first")
    sets = seen.groupBy("set_a", "set_b").agg(first, F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    sets = cut(sets.withColumn("node", F.monotonically_increasing_id()), "sketch-sets")  # written, so a node keeps its number
    keyed = spread(sets.select(F.explode("keys").alias("k"), "node", "fp", "keys"), "node", most)
    keyed = keyed.select("q", "k", "node", "fp", "keys").repartition("q").sortWithinPartitions("q", "node")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, k, nodes, prints, lists in whole_keys(batches, 50_000):
            lows, sizes, k = np.full((len(q), keys), NO_KEY), lists.value_lengths().to_numpy(), k.to_numpy()
            lows[np.arange(keys)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
            own = marked(q, k, wide_prints(prints, wide_words), lows, short, long)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.to_numpy()[own]), pa.array(k[own])], ["node", "k"])

    near = cut(keyed.mapInArrow(tidy(mark), "node long, k long").distinct(), "sketch-near")
    near = spread(near, "node", max(1, most // 4)).groupBy("node").agg(F.collect_list("q").alias("at"))
    asked = sets.join(near, "node").select(F.col("first.doc_id").alias("w_id"), F.col("first.t1").alias("w1"), F.col("first.t2").alias("w2"), "node", "fp", "at")
    base = named(docs)
    if repeated(seen).limit(1).count():
        base = base.dropDuplicates(["doc_id", "t1", "t2"])
    texts = base.join(asked, base["doc_id"].eqNullSafe(asked["w_id"]) & (base["t1"] == asked["w1"]) & (base["t2"] == asked["w2"])).select("text", "node", "fp", "at")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 256):
                batch = whole.slice(part, 256)
                hashes = [np.sort(shingle_hashes(t.as_py().encode(), words_per_shingle)).tobytes() for t in batch.column(0)]
                at = batch.column(3)
                row = np.repeat(np.arange(batch.num_rows), at.value_lengths().to_numpy())
                yield pa.RecordBatch.from_arrays([at.flatten(), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array([hashes[i] for i in row.tolist()], pa.binary())], ["q", "node", "fp", "hashes"])

    unfolded = texts.mapInArrow(tidy(unfold), "q long, node long, fp binary, hashes binary").repartition("q").sortWithinPartitions("q", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, nodes, prints, hashes in whole_keys(batches, 5_000):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in hashes]
            found = same_sets(q, nodes.to_numpy(), wide_prints(prints, wide_words), sets, short, long, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["src", "dst"])

    label = connected_components(unfolded.mapInArrow(tidy(compare), "src long, dst long"))
    linked = sets.join(label, "node", "left").select("set_a", "set_b", "first", F.coalesce("label", "node").alias("label"))
    return seen.select("doc_id", "t1", "t2", "set_a", "set_b"), linked


def repeated(seen: DataFrame) -> DataFrame:
    """(doc_id, t1, t2) of the rows that are there more than once."""
    return seen.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "t1", "t2")


def similar(docs: DataFrame, similarity: float = SIMILARITY, words_per_shingle: int = WORDS, wide_words: int = WIDE_WORDS, keys: int = KEYS) -> DataFrame:
    """(doc_id, t1, t2, component_id) of every row: texts whose sets of shingles have the similarity are linked.

    64 bits within a few do not reach down to a similarity of 0.8, so fingerprints have 64 * wide_words bits here, and two
    texts meet if they share one of the ``keys`` smallest of their hashes (similar sets miss with probability
    (1 - similarity) ** keys).  There the first 64 bit planes are compared bit-sliced, and who is near in them by all bits.
    That only marks the texts that have a near one: their sets meet under the key, and the sets' own similarity decides.
    Texts with one set of shingles are one from the start; every bucket emits a spanning forest.  t1 and t2 are digests of
    the text; component_id is the smallest doc_id reachable, null where none has one.
    """
    seen, sets = set_groups(docs, similarity, words_per_shingle, wide_words, keys)
    label = sets.join(sets.groupBy("label").agg(F.min("first").alias("group")), "label").select("set_a", "set_b", F.col("group.doc_id").alias("component_id"))
    return seen.join(label, ["set_a", "set_b"]).select("doc_id", "t1", "t2", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words_per_shingle: int = WORDS, wide_words: int = WIDE_WORDS, keys: int = KEYS) -> DataFrame:
    """docs with one row of each group of similar texts, whichever rows share a doc_id.

    The row with the smallest doc_id stays, rows without one coming last; of several texts of that doc_id in the group the one with
    the smallest digest; of several rows with that doc_id and text the one with the smallest digest of its columns.
    """
    seen, sets = set_groups(docs, similarity, words_per_shingle, wide_words, keys)
    first = sets.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("w_id"), F.col("first.t1").alias("w1"), F.col("first.t2").alias("w2"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = [c for c, t in zip(columns_of(docs), docs.dtypes, strict=True) if "map<" not in t[1] and "variant" not in t[1]]
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), F.xxhash64(*plain).alias("digest"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    kept = rows.join(first, rows["own_id"].eqNullSafe(first["w_id"]) & (rows["t1"] == first["w1"]) & (rows["t2"] == first["w2"]), "left_semi")
    again = repeated(seen).withColumnsRenamed({"doc_id": "w_id", "t1": "w1", "t2": "w2"})
    if again.limit(1).count():
        same = kept["own_id"].eqNullSafe(again["w_id"]) & (kept["t1"] == again["w1"]) & (kept["t2"] == again["w2"])
        several = kept.join(again, same, "left_semi").groupBy("own_id", "t1", "t2").agg(F.min_by("row", "digest").alias("row"))
        kept = kept.join(again, same, "left_anti").select("row").unionByName(several.select("row"))
    return kept.select("row.*")
