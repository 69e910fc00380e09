"""Exact Jaccard join of shingle sets by partitioning the universe of shingles and the pigeonhole principle.

Two sets of sizes a and b with Jaccard >= t differ in at most d = (a + b)(1 - t) / (1 + t) shingles. Hash the
universe into m > d segments: at least m - d segments of the two sets are identical. Segments are indexed by
(size band, segment number, sum of its hashes); documents that share a key are candidates.

Cost-based allocation. A segment that is empty, or made of shingles that very many documents hold, would be a key
of very many documents. So only rare shingles are dealt into segments (frequent ones count as allowed differences,
which keeps the bound), and each band gets a few more segments than needed, so that a set may skip its empty ones:
of a pair's identical segments one is not empty unless both sets have more empty ones than there are spare ones.
Only such sets, nearly all of whose shingles are frequent, get a second index: a key for each rare shingle, which
finds their partners that share one, and segments over their frequent shingles, which find those that share none.
In bands of at most two differences segments are few and a one-deletion neighbourhood is cheap: with one difference
the whole set is a segment that may differ by one, with two there is a second one that must be identical. A segment
that may differ by one is indexed with each of its shingles left out, and whole.

Which shingles count as frequent only decides the cost; every choice gives the same links.

Copies are collapsed first: sets are known by a 128-bit hash, and only one row of a class per task is indexed.
Candidates are verified exactly, on the sets made again from their texts. Links are not needed one by one, only
the classes they connect: a key of few documents gives all its pairs; a key of many compares all with a few
pivots, the smallest sets first, and later only members that are still in different components and whose odd bits
(is the number of shingles of each of 512 classes odd?) differ in no more places than their sets may.

Defined cases. Null texts and texts without words have the empty set: n_shingles 0, linked with nothing. A text of
fewer words than a shingle is one shingle. Every input row gives one row; rows are told apart by their sets, so
repeated rows link like any copies. A component's id is its smallest non-null doc_id; a document without links has
its own. Null ids take part in links. Other columns are never read.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyslot.llm.common import column, slices
from tallyslot.sources.workdir import materialise

SHINGLE, PER_CENT = 4, 85
#: A shingle is frequent when so many documents hold it, as far as single tasks see it twice or more.
FREQUENT = 64
#: At most so many frequent shingles are told apart, the most frequent ones; 8 bytes each go to every task.
MOST_FREQUENT = 200_000
#: Keys of up to so many sets give all pairs at once.
SMALL_KEY = 32
#: Sets that all others of a large key are compared with at first.
PIVOTS = 4
#: Representatives looked up by broadcast up to so many (some 120 bytes each, of which the driver holds several copies).
BROADCAST_ROWS = 100_000
#: Up to so many, only documents with a wanted key (8 bytes each at every task) are shuffled to meet them, else all.
KEYED_ROWS = 3_000_000
#: Shingles that a counting task holds at once, and pairs that a pairing task holds at once.
HELD_SHINGLES, HELD_PAIRS = 1_000_000, 1_000_000

#: Columns of 64 odd bits each (see ``oddness``); a power of two.
ODD = [f"odd{i}" for i in range(8)]

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
FNV = np.uint64(0x100000001B3)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 120_000

    def __init__(self):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.digest = xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = self.digest(word)
        return h


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. bytes.lower() and bytes.split() know only ASCII, as wanted."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, np.uint64(min(len(words), size)), np.uint64)
    for i in range(min(size, len(words))):
        out = mixed(out ^ (h[i : i + n] * MIX[i % len(MIX)]), i)
    return np.unique(out)


def class_key(tokens: np.ndarray) -> bytes | None:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


# Bands of sizes. Band k holds the sizes of (top(k - 1), top(k)]; partners of a set lie in its band or the ones beside it.


def band_tops(per_cent: int, most: int = 1 << 40) -> np.ndarray:
    tops, n = [], 1
    while n < most:
        tops.append(n)
        n = max(n + 1, n * 100 // per_cent)
    return np.array(tops, np.int64)


def differences(both: int, per_cent: int) -> int:
    """The most shingles in which sets of this total size may differ: both - 2 i with 100 i >= per_cent (both - i)."""
    return both - 2 * -(-per_cent * both // (100 + per_cent))


def smallest_partner(n: int, per_cent: int) -> int:
    return -(-n * per_cent // 100)


class Layout:
    """Differences d and segments m of each band; ``spare`` of the m segments may be skipped."""

    def __init__(self, per_cent: int):
        self.per_cent, self.tops = per_cent, band_tops(per_cent)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.tops, n))

    def bands(self, n: int) -> range:
        """Where a set is indexed: the bands of all sizes that the smaller set of a pair with it may have."""
        return range(self.band(max(1, smallest_partner(n, self.per_cent))), self.band(n) + 1)

    def plan(self, k: int) -> tuple[int, int, int]:
        """(d, m, spare) for pairs whose smaller set is in band k."""
        top = int(self.tops[k])
        both = top + top * 100 // self.per_cent
        d = max(0, differences(both, self.per_cent), differences(both - 1, self.per_cent))
        spare = 2 + (d + 1) // 8
        return d, d + 1 + spare, spare


def sums(tokens: np.ndarray, m: int, k: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the segments that are not empty, and how many each segment holds."""
    seg = ((mixed(tokens, salt) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    held = np.bincount(seg.astype(np.int64), minlength=m)
    order = np.argsort(seg, kind="stable")
    full = np.flatnonzero(held)
    starts = np.cumsum(held[full]) - held[full]
    total = np.add.reduceat(mixed(tokens, salt + 1)[order], starts) if len(full) else np.zeros(0, np.uint64)
    return mixed(total ^ (full.astype(np.uint64) * FNV), 7 * k + salt), held


def key_rows(tokens: np.ndarray, frequent: np.ndarray, layout: Layout) -> tuple[np.ndarray, int, int]:
    """All keys of a set; 1 in the lowest bit marks keys for pairs that share no rare shingle. And its number of
    rare shingles, and 1 if it is mostly frequent."""
    n = len(tokens)
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
    else:
        common = np.zeros(n, bool)
    rare = tokens[~common]
    keys, mostly = [], 0
    for k in layout.bands(n):
        d, m, spare = layout.plan(k)
        if d == 0:
            continue  # only identical sets link
        if d <= 2:
            values = mixed(tokens, 3)
            second = (mixed(tokens, 5) & np.uint64(1)).astype(bool) if d == 2 else np.zeros(n, bool)
            loose = values[~second]
            total = np.add.reduce(loose)
            keys.append(mixed(np.append(total - loose, total), 1000 + k) & ~np.uint64(1))
            if d == 2:
                keys.append(mixed(np.add.reduce(values[second], keepdims=True), 3000 + k) & ~np.uint64(1))
            continue
        full, held = sums(rare, m, k, 11)
        keys.append(full & ~np.uint64(1))
        if (held == 0).sum() > spare:
            mostly = 1
            if 100 * (n - len(rare)) >= layout.per_cent * n:  # else it links with none by frequent shingles alone
                own, held = sums(tokens[common], d + 1, k, 21)
                none = np.flatnonzero(held == 0).astype(np.uint64)
                keys.append(own | np.uint64(1))
                keys.append(mixed(none * FNV, 5000 + k) | np.uint64(1))
    if mostly:
        keys.append(mixed(rare, 31) & ~np.uint64(1))
    return (np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)), len(rare), mostly


def may_link(na, nb, ra, rb, blind, per_cent: int):
    """False for pairs that cannot link by their sizes, nor, under a key for pairs without a common rare shingle,
    by their numbers of frequent ones. Works on arrays."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    fits = 100 * small >= per_cent * large
    ha, hb = na - ra, nb - rb
    most = np.minimum(ha, hb)
    return fits & (~blind | (100 * most >= per_cent * (na + nb - most)))


# Steps over the documents


def described(docs: DataFrame, doc_id: str, text: str, shingle: int, most: int = MOST_FREQUENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, class, odd0 .. of every row, and shingle, n counted within tasks in rows of their
    own: sets are made once for both."""
    rows = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    added = T._parse_datatype_string("text_hash long, n_shingles long, class binary, " + ", ".join(f"{o} long" for o in ODD) + ", shingle long, n long")
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *added.fields])
    shown = to_arrow_schema(schema)

    def run(batches):
        hashes, counter = WordHashes(), ShingleCounts(most)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in slices(texts):
                sets = [shingle_set(t, hashes, shingle) for t in texts[lo:hi]]
                for s in sets:
                    counter.add(s)
                odd = np.array([oddness(s) for s in sets])
                size = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, size), batch.column(1).slice(lo, size), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([class_key(s) for s in sets], pa.binary()), *(pa.array(odd[:, i]) for i in range(len(ODD))),
                        pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()),
                    ],
                    schema=shown,
                )
        held, counts = counter.counted()
        if len(held):
            none = [pa.nulls(len(held), f.type) for f in list(shown)[:-2]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(held.view(np.int64)), pa.array(counts)], schema=shown)

    return rows.mapInArrow(run, schema)


class ShingleCounts:
    """How many sets of a task hold each shingle, as far as it sees them twice or more; the ``most`` most frequent ones."""

    def __init__(self, most: int):
        self.most, self.held, self.counts = most, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pending, self.size = [], 0

    def add(self, tokens: np.ndarray) -> None:
        self.pending.append(tokens)
        self.size += len(tokens)
        if self.size > HELD_SHINGLES:
            self.fold()

    def fold(self) -> None:
        new, got = np.unique(np.concatenate(self.pending), return_counts=True)
        self.pending, self.size = [], 0
        # once seen among a million shingles says little; that keeps this table small
        new, got = new[got > 1], got[got > 1]
        self.held, at = np.unique(np.concatenate([self.held, new]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, got])).astype(np.int64)
        if len(self.held) > self.most:
            best = np.sort(np.argsort(-self.counts, kind="stable")[: self.most])
            self.held, self.counts = self.held[best], self.counts[best]

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        if self.pending:
            self.fold()
        return self.held, self.counts


def oddness(tokens: np.ndarray) -> np.ndarray:
    """For each of some classes of shingles, a bit: is their number in the set odd? Two sets differ in at least as many
    shingles as in such bits."""
    bits = np.bincount((tokens & np.uint64(64 * len(ODD) - 1)).astype(np.int64), minlength=64 * len(ODD)) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def differ_little(na: str, nb: str, a: str, b: str, per_cent: int) -> Column:
    """False for pairs whose odd bits differ in more places than the shingles of linked sets of these sizes may."""
    differing = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{o}").bitwiseXOR(F.col(f"{b}.{o}"))) for o in ODD])
    return (100 + per_cent) * differing <= (100 - per_cent) * (F.col(na) + F.col(nb))


def frequent_shingles(counted: DataFrame, least: int = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """The most frequent shingles, from counts within tasks that are added up."""
    seen = counted.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = seen.orderBy(F.desc("n"), "shingle").limit(most).select("shingle").toArrow()
    return np.unique(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def indexed(docs: DataFrame, text: str, frequent: np.ndarray, per_cent: int, shingle: int) -> DataFrame:
    """key, node (64 bits of the class), n, rare: one row per key and set; a task leaves out sets it has seen."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches):
        hashes, layout, seen = WordHashes(), Layout(per_cent), set()
        for batch in batches:
            keys, nodes, sizes, rares, counts = [], [], [], [], []
            for t in batch.column(0).to_pylist():
                tokens = shingle_set(t, hashes, shingle)
                if not len(tokens):
                    continue
                node = int.from_bytes(class_key(tokens)[:8], "big", signed=True)
                if node in seen:
                    continue
                if len(seen) < 300_000:
                    seen.add(node)
                got, rare, _ = key_rows(tokens, known.value, layout)
                if len(got):
                    keys.append(got)
                    nodes.append(node)
                    sizes.append(len(tokens))
                    rares.append(rare)
                    counts.append(len(got))
            if keys:
                flat = np.concatenate(keys).view(np.int64)
                for lo in range(0, len(flat), 200_000):
                    of = np.repeat(np.arange(len(counts)), counts)[lo : lo + 200_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(flat[lo : lo + 200_000]), pa.array(np.array(nodes, np.int64)[of]),
                            pa.array(np.array(sizes, np.int32)[of]), pa.array(np.array(rares, np.int32)[of]),
                        ],
                        names=["key", "node", "n", "rare"],
                    )

    return docs.select(column(text).cast("string")).mapInArrow(emit, "key long, node long, n int, rare int")


def met(rows: DataFrame, per_cent: int, small: int, pivots: int) -> DataFrame:
    """From rows dealt out by key: kind 'pair' (a, b) to verify, kind 'big' (key, a, n, rare) for members of large keys."""

    def group(batches):
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        key, node, n, rare = (t.column(i).to_numpy() for i in range(4))
        del held, t
        order = np.lexsort((node, key))
        key, node, n, rare = key[order], node[order], n[order].astype(np.int64), rare[order].astype(np.int64)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n, rare = key[new], node[new], n[new], rare[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        left, right, waiting = [], [], 0

        def pair(i, j):
            nonlocal waiting
            ok = may_link(n[i], n[j], rare[i], rare[j], (key[i] & 1).astype(bool), per_cent)
            left.append(np.minimum(node[i[ok]], node[j[ok]]))
            right.append(np.maximum(node[i[ok]], node[j[ok]]))
            waiting += len(left[-1])

        def given():
            nonlocal waiting
            a, b = (np.concatenate([node[:0], *side]) for side in (left, right))
            left.clear(), right.clear()
            waiting = 0
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b = a[new], b[new]
            for lo in range(0, len(a), 100_000):
                z = np.zeros(len(a[lo : lo + 100_000]), np.int64)
                yield batch("pair", a[lo : lo + 100_000], b[lo : lo + 100_000], z, z, z)

        for s in np.unique(sizes[(sizes > 1) & (sizes <= small)]):
            at = starts[sizes == s]
            a, b = np.triu_indices(int(s), 1)
            step = max(1, HELD_PAIRS // 4 // len(a))
            for lo in range(0, len(at), step):
                some = at[lo : lo + step, None]
                pair((some + a).ravel(), (some + b).ravel())
                if waiting > HELD_PAIRS:
                    yield from given()
        for at, s in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            members = at + np.lexsort((node[at : at + s], n[at : at + s]))
            for p in range(min(pivots, s - 1)):
                pair(np.full(s - p - 1, members[p]), members[p + 1 :])
                if waiting > HELD_PAIRS:
                    yield from given()
            for lo in range(0, s, 100_000):
                some = members[lo : lo + 100_000]
                yield batch("big", node[some], node[some], key[some], n[some], rare[some])
        yield from given()

    def batch(kind, a, b, key, n, rare):
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(a)), *map(pa.array, (a, b, key, n, rare))], names=["kind", "a", "b", "key", "n", "rare"]
        )

    return rows.mapInArrow(group, "kind string, a long, b long, key long, n long, rare long")


def among(keys: DataFrame, key: Column) -> Column:
    """Is a 64-bit key one of some? Only the keys themselves are sent, not the rows they stand for."""
    known = keys.sparkSession.sparkContext.broadcast(np.unique(keys.toArrow().column(0).to_numpy()))

    @F.arrow_udf("boolean")
    def there(asked: pa.Array) -> pa.Array:
        own, held = asked.to_numpy(), known.value
        return pa.array(held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own)

    return there(key)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, per_cent: int, shingle: int) -> DataFrame:
    """The links among candidate pairs, as classes a < b; texts are fetched once per class."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    reps = materialise(nodes.join(wanted, "node", "left_semi"), "jaccard-reps")
    asked = reps.select("class", F.col("rep.doc_id").alias("rep id"), F.col("rep.text_hash").alias("rep hash"), "node")
    whole = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("text"))
    number = reps.count()
    if number <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    elif number <= KEYED_ROWS:
        keys = asked.select(F.xxhash64("rep id", "rep hash").alias("key"))
        whole = whole.filter(among(keys, F.xxhash64("id", F.xxhash64("text"))))
    same = F.xxhash64(whole["text"]).eqNullSafe(asked["rep hash"]) & whole["id"].eqNullSafe(asked["rep id"])
    texts = materialise(whole.join(asked, same).select("node", "class", "text").dropDuplicates(["class"]), "jaccard-texts")

    def side(name):
        return texts.select(F.col("node").alias(name), F.col("class").alias(f"{name}_class"), F.col("text").alias(f"{name}_text"))

    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def check(batches):
        hashes = WordHashes()
        made = lru_cache(maxsize=256)(lambda t: shingle_set(t, hashes, shingle))
        for b in batches:
            keep = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens, other = made(x), made(y)
                shared = len(np.intersect1d(tokens, other, assume_unique=True))
                keep.append(100 * shared >= per_cent * (len(tokens) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a_text", "b_text", "a_class", "b_class").mapInArrow(check, "a binary, b binary")


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """node, root (the smallest node of its component), for all nodes of the links (a, b), by alternating stars."""
    edges = materialise(
        links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = big.union(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct(), label)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def judged(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_cent: int = PER_CENT, least: int = FREQUENT,
    small: int = SMALL_KEY, pivots: int = PIVOTS, shingle: int = SHINGLE,
) -> DataFrame:
    """doc_id, text_hash, n_shingles, root (the component's smallest class, null for the empty set) of every row."""
    seen = materialise(described(docs, doc_id, text, shingle), "jaccard-sets")
    known, counted = seen.filter("shingle IS NULL").drop("shingle", "n"), seen.filter("shingle IS NOT NULL").select("shingle", "n")
    node = F.conv(F.hex(F.substring("class", 1, 8)), 16, -10).cast("long")
    nodes = known.filter("class IS NOT NULL").groupBy("class").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), *[F.first(o).alias(o) for o in ODD]
    )
    nodes = materialise(nodes.withColumn("node", node), "jaccard-classes")
    frequent = frequent_shingles(counted, least)
    rows = indexed(docs, text, frequent, per_cent, shingle).repartition("key")
    found = materialise(met(rows, per_cent, small, pivots), "jaccard-met")
    pairs = materialise(found.filter("kind = 'pair'").select("a", "b").distinct(), "jaccard-pairs")
    links = materialise(verified(pairs, docs, nodes, doc_id, text, per_cent, shingle), "jaccard-links")
    big = found.filter("kind = 'big'").select("key", F.col("a").alias("node"), "n", "rare")
    if not big.isEmpty():
        links = links.union(rest(big, links, docs, nodes, doc_id, text, per_cent, shingle))
    roots = components(links)
    out = known.join(roots, F.col("class") == F.col("node"), "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("root", "class").alias("root"))


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. Options as of judged()."""
    rows = judged(docs, **options)
    first = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id")
    )


def rest(big, links, docs, nodes, doc_id, text, per_cent, shingle) -> DataFrame:
    """Links between members of large keys that the pivots left in different components."""
    roots = components(links)
    named = nodes.select("node", "class", *ODD).join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.select("node", F.coalesce("root", "class").alias("root"), *ODD)
    rows = big.join(named, "node")
    mixed_keys = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key")
    rows = materialise(rows.join(mixed_keys, "key", "left_semi"), "jaccard-mixed")
    # a pair is emitted under the smallest of its common keys only, not under each. Spark would take these rows for as
    # small as their files and broadcast them: they are merged
    rows = rows.join(rows.groupBy("node").agg(F.collect_set("key").alias("all")).hint("merge"), "node")
    a, b = rows.alias("a"), rows.hint("merge").alias("b")
    shared = F.array_intersect("a.all", "b.all")
    fits = 100 * F.least("a.n", "b.n") >= per_cent * F.greatest("a.n", "b.n")
    most = F.least(F.expr("a.n - a.rare"), F.expr("b.n - b.rare"))
    sighted = F.exists(shared, lambda k: k.bitwiseAND(1) == 0)
    could = sighted | (100 * most >= per_cent * (F.col("a.n") + F.col("b.n") - most))
    once = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & F.expr("a.root != b.root")
    near = differ_little("a.n", "b.n", "a", "b", per_cent)
    pairs = a.join(b, once & fits & near & (F.array_min(shared) == F.col("a.key")) & could)
    pairs = materialise(pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "jaccard-pairs")
    return materialise(verified(pairs, docs, nodes, doc_id, text, per_cent, shingle), "jaccard-links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; documents without words stay.

    Of repeated rows of that document one stays; only those are shuffled once more.
    """
    rows = materialise(judged(docs, **options), "jaccard-judged")
    first = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    first = first.select("root", "first", F.lit(True).alias("led"))
    rows = rows.join(first, "root", "left")
    kept = rows.filter("led IS NULL OR struct(doc_id, text_hash) <=> first")
    kept = kept.groupBy(F.col("doc_id").alias("kept id"), F.col("text_hash").alias("kept hash")).agg(
        (F.count("*") > 1).alias("again"), F.max("n_shingles").alias("kept size")
    )
    kept = materialise(kept.withColumn("again", F.expr("again AND `kept size` > 0")).drop("kept size"), "jaccard-kept")
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    same = docs[doc_id].eqNullSafe(kept["kept id"]) & (F.xxhash64(docs[text].cast("string")) == kept["kept hash"])
    once = docs.join(kept.filter("NOT again"), same, "left_semi")
    return once.union(docs.join(kept.filter("again"), same, "left_semi").dropDuplicates([doc_id, text]))
