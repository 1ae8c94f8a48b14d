"""Documents whose sets of word n-grams are alike by Jaccard, joined on vertical fragments of one order of all n-grams.

An n-gram is a 64-bit hash, and the order of hashes is the global order: it is known without counting, and cutting the
range of hashes cuts every set into segments of nearly equal length. One fragment is one vertical part of the join.

1. Sets. Documents with equal sets form a class; a class has a key (from its set) and its smallest doc_id.
2. Candidates. Two sets of m and n n-grams with the asked similarity p percent differ in at most
   (m + n) * (100 - p) / (100 + p) n-grams. Cut into one more fragment than that, they have a fragment in which their
   segments are the same, as each differing n-gram spoils one fragment. So a class lists the hash of each of its
   segments. The number of fragments is that of a class of sizes; sizes that may link are in the same class or in
   neighbouring ones, so a set lists its segments by the cut of its own class and by that of the next larger one.
   Segments without n-grams say nothing; a set that has one lists its first n-grams in the global order as well, as many
   as a partner can't do without (the prefix of the order), and two sets of which only empty segments agree meet there.
   So no pair is missed, at any size.
3. Hubs. Each list is paired with one member, which is linear in the lists; of what those pairs link, components are
   made. Then lists that still hold several components are joined with themselves. A pair inside one component can't
   change the result. Long lists are split among tasks.
4. Bound. Sets whose parities in equal buckets of n-grams differ in more places than the sets may differ in are no
   partners (an exact bound, never an estimate), so few pairs of unlike sets get further.
5. Counts. Of the pairs left, each of ``fragments`` equal fragments counts the overlap of its two segments on its own;
   the counts are summed for each pair and compared with the threshold. No row or task holds more than a segment.

Results are those of comparing all pairs, but for collisions of 64-bit hashes. Null ids: such rows link with nothing and
have a null component. Null or empty texts, or texts without words: an empty set, linked with nothing. Rows that repeat
an id: each links by its own text, and all with the same smallest id are one node; equal rows are equal results. Ties:
the smallest id names a component. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle, task_batches
from .components import components
from .near_dedup import bit_at, bit_table
from .shingles import U, mix, shingle_sets

#: Fragments in which the overlaps of a pair are counted.
FRAGMENTS = 4
#: Bits of the tables of listed values and of wanted ids, which only save work.
LISTED_BITS, ID_BITS = 26, 24
#: Open members of a list that one task compares with the list.
AT_ONCE = 2048
#: Longest parity sketch, in words of 64 bits.
SKETCH_WORDS = 64


class Cuts:
    """Classes of sizes and the cut of each, for one threshold."""

    def __init__(self, percent: int) -> None:
        # A little more than the ratio that the threshold allows, so rounding can't put partners two classes apart.
        self.percent, self.step = percent, max(math.log(100 / percent) * (1 + 1e-9), 0.01)
        self.bounds: dict[int, np.ndarray] = {}

    def of(self, n: int) -> int:
        return math.floor(math.log(n) / self.step)

    def largest(self, k: int) -> int:
        return math.floor(math.exp((k + 1) * self.step)) + 1

    def fragments(self, k: int) -> int:
        """One more than the n-grams in which two sets of at most this class's largest size may differ."""
        return 2 * self.largest(k) * (100 - self.percent) // (100 + self.percent) + 1

    def edges(self, fragments: int) -> np.ndarray:
        """Where fragments 1, 2, ... of the range of hashes begin."""
        if fragments not in self.bounds:
            if len(self.bounds) > 64:
                self.bounds.clear()
            self.bounds[fragments] = np.arange(1, fragments, dtype=U) * U(2**64 // fragments)
        return self.bounds[fragments]

    def words(self, n: int) -> int:
        """64-bit words of the parity sketch of a set of n."""
        return min(SKETCH_WORDS, 1 << max(0, (self.largest(self.of(n)) - 1).bit_length() - 6))


def listed(s: np.ndarray, sums: np.ndarray, k: int, cuts: Cuts) -> np.ndarray:
    """The values under which a set is listed by the cut of size class k; sums are those of its mixed n-grams."""
    parts = cuts.fragments(k)
    at = np.concatenate(([0], np.searchsorted(s, cuts.edges(parts)), [len(s)]))
    full = np.flatnonzero(at[1:] > at[:-1])
    salt = mix(np.full(1, U(2 * k + 1)))
    values = mix((sums[at[full + 1]] - sums[at[full]]) ^ mix(full.astype(U) + salt))
    if len(full) == parts:
        return values
    need = -(-cuts.percent * len(s) // 100)
    return np.concatenate((values, mix(s[: len(s) - need + 1] ^ mix(salt + U(1)))))


def parities(s: np.ndarray, words: int) -> np.ndarray:
    """For each of 64 * words buckets whether it has an odd number of n-grams."""
    odd = (np.bincount((s & U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def digest(mixed: np.ndarray) -> int:
    """The key of a set, from its mixed n-grams."""
    both = np.array([mixed.sum(dtype=U), np.bitwise_xor.reduce(mixed * U(0x9E3779B97F4A7C15))], U)
    return int(mix(both[:1] ^ mix(both[1:] + U(len(mixed))))[0])


def sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, key, and the values listed by the set's own class (own) and the next larger one (up), parity."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cuts = Cuts(percent)
        for batch in task_batches(batches, "shingles", 256):
            n, key, lists = [], [], ([], [], [])
            nothing = np.empty(0, np.int64)
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets((x.as_py() for x in batch.column("text")), width), strict=True):
                n.append(len(s))
                if not len(s) or doc is None:
                    key.append(0)
                    found = (nothing, nothing, nothing)
                else:
                    mixed = mix(s)
                    key.append(digest(mixed))
                    k, sums = cuts.of(len(s)), np.concatenate((np.zeros(1, U), np.cumsum(mixed)))
                    found = tuple(listed(s, sums, c, cuts).view(np.int64) if cuts.fragments(c) > 1 else nothing for c in (k, k + 1)) + (parities(s, cuts.words(len(s))),)
                for column, values in zip(lists, found, strict=True):
                    column.append(values)
            ends = [np.cumsum([0, *map(len, column)]).astype(np.int32) for column in lists]
            arrays = [pa.ListArray.from_arrays(pa.array(e), pa.array(np.concatenate(column))) for e, column in zip(ends, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(key, U).view(np.int64)), *arrays], names=["doc_id", "n_shingles", "key", "own", "up", "parity"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, sign, "doc_id long, n_shingles long, key long, own array<long>, up array<long>, parity array<long>")


def postings(classes: DataFrame, several) -> DataFrame:
    """value, key, n, up: the values that several classes may have listed."""

    def post(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in task_batches(batches, "shingles"):
            key, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n"))
            for up, name in enumerate(("own", "up")):
                column = batch.column(name)
                values, of = column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
                at = np.flatnonzero(bit_at(several.value, values.view(U), LISTED_BITS)) if len(values) else of
                yield pa.RecordBatch.from_arrays([pa.array(values[at]), pa.array(key[of[at]]), pa.array(n[of[at]]), pa.array(np.full(len(at), bool(up)))], names=["value", "key", "n", "up"])

    return classes.select("key", F.col("n").cast("int").alias("n"), "own", "up").transform(map_arrow, post, "value long, key long, n int, up boolean")


def sizes_fit(m: str, n: str, percent: int) -> Column:
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def parities_fit(x: str, y: str, m: str, n: str, percent: int) -> Column:
    """Whether sets of m and n n-grams with these parities may differ in few enough; sketches of two lengths say nothing."""
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, b: s + b)
    return F.when(F.size(x) != F.size(y), True).otherwise(apart * (100 + percent) <= (F.col(m) + F.col(n)) * (100 - percent))


def segments(docs: DataFrame, width: int, fragments: int, wanted) -> DataFrame:
    """key, fragment, grams of documents whose id may be wanted: the n-grams of each fragment of the order."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        edges = np.arange(1, fragments, dtype=U) * U(2**64 // fragments)
        for batch in task_batches(batches, "shingles", 256):
            ids = batch.column("doc_id").to_pylist()
            at = [i for i, x in enumerate(ids) if x is not None]
            hit = bit_at(wanted.value, np.array([ids[i] for i in at], np.int64).view(U), ID_BITS) if at else []
            at = [i for i, h in zip(at, hit, strict=True) if h]
            text = batch.column("text")
            keys, places, grams = [], [], []

            def out() -> pa.RecordBatch:
                ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams).view(np.int64)))
                return pa.RecordBatch.from_arrays([pa.array(np.array(keys, U).view(np.int64)), pa.array(places, pa.int32()), lists], names=["key", "fragment", "grams"])

            size = 0
            for s in shingle_sets((text[i].as_py() for i in at), width):
                if len(s):
                    grams += np.split(s, np.searchsorted(s, edges))
                    keys += [digest(mix(s))] * fragments
                    places += range(fragments)
                    size += len(s)
                if size > 1 << 19:
                    yield out()
                    keys, places, grams, size = [], [], [], 0
            if keys:
                yield out()

    rows = docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, cut, "key long, fragment int, grams array<long>")
    return rows.groupBy("key", "fragment").agg(F.max("grams").alias("grams"))


def overlaps(pairs: DataFrame, parts: DataFrame, fragments: int) -> DataFrame:
    """a, b, common: each fragment counts what the two segments share, and the counts are summed."""
    sides = F.array(F.struct(F.col("a").alias("key"), F.lit(True).alias("first")), F.struct(F.col("b").alias("key"), F.lit(False).alias("first")))
    every = F.sequence(F.lit(0), F.lit(fragments - 1))
    asked = pairs.select("a", "b", F.explode(sides).alias("s")).select("a", "b", "s.*", F.explode(every).alias("fragment"))
    held = asked.join(parts, ["key", "fragment"]).groupBy("a", "b", "fragment").agg(F.max(F.when(F.col("first"), F.col("grams"))).alias("x"), F.max(F.when(~F.col("first"), F.col("grams"))).alias("y"))
    partial = held.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("overlap"))
    return partial.groupBy("a", "b").agg(F.sum("overlap").alias("common"))


class Join:
    """The steps over one table of documents; ``classes`` has a row for each different set."""

    def __init__(self, docs: DataFrame, width: int, percent: int, fragments: int) -> None:
        self.docs, self.width, self.percent, self.fragments = docs, width, percent, fragments
        self.sc = docs.sparkSession.sparkContext
        self.signed = settle(sets(docs, width, percent))
        one = F.min(F.struct("doc_id", "n_shingles", "own", "up", "parity")).alias("one")
        held = self.signed.where("n_shingles > 0 and doc_id is not null").groupBy("key").agg(one, F.count(F.lit(1)).alias("copies"))
        self.classes = settle(held.select("key", F.col("one.doc_id").alias("id"), F.col("one.n_shingles").alias("n"), "one.own", "one.up", "one.parity", "copies"))
        self.slim = self.classes.select("key", "id", "n", "parity", "copies")

    def postings(self) -> DataFrame:
        several = settle(self.classes.select(F.explode(F.concat("own", "up")).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
        table = self.sc.broadcast(bit_table(several, "value", LISTED_BITS))
        posts = settle(postings(self.classes, table))
        table.unpersist()
        return posts

    def met_hubs(self, posts: DataFrame) -> DataFrame:
        """a, b, m, n: every member of a list with the list's hub, one of those listed by their own class."""
        hub = F.min(F.when(~F.col("up"), F.struct(F.xxhash64("key").alias("h"), "key", "n"))).alias("hub")
        hubs = posts.groupBy("value").agg(hub, F.count(F.lit(1)).alias("members")).where("members > 1 and hub is not null")
        met = posts.join(hubs, "value").select(F.col("hub.key").alias("u"), F.col("hub.n").alias("m"), F.col("key").alias("v"), "n").where("u <> v").where(sizes_fit("m", "n", self.percent))
        return met.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()

    def met_apart(self, posts: DataFrame, parts: DataFrame) -> DataFrame:
        """Members of the same list that are still in different components and may be alike."""
        labelled = posts.join(parts, "key")
        lists = labelled.groupBy("value").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo < hi")
        spread = F.ceil(F.col("members") / F.lit(AT_ONCE)).cast("int")
        members = labelled.join(lists.select("value", spread.alias("spread")), "value").join(self.slim.select("key", "parity"), "key")
        x = members.where("not up").select("value", F.pmod(F.xxhash64("key"), F.col("spread")).cast("int").alias("salt"), F.col("key").alias("u"), F.col("n").alias("m"), F.col("part").alias("part_u"), F.col("parity").alias("x"))
        y = members.select("value", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"), F.col("key").alias("v"), "n", "up", F.col("part").alias("part_v"), F.col("parity").alias("y"))
        apart = (F.col("part_u") != F.col("part_v")) & (F.col("up") | (F.col("u") < F.col("v"))) & sizes_fit("m", "n", self.percent) & parities_fit("x", "y", "m", "n", self.percent)
        return x.join(y, ["value", "salt"]).where(apart).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """a, b, common (n-grams in both) and the smallest ids ia, ib of the pairs that link."""
        left = self.slim.select(F.col("key").alias("a"), F.col("id").alias("ia"), F.col("n").alias("m"), F.col("parity").alias("x"))
        right = self.slim.select(F.col("key").alias("b"), F.col("id").alias("ib"), "n", F.col("parity").alias("y"))
        likely = settle(pairs.join(left, "a").join(right, "b").where(parities_fit("x", "y", "m", "n", self.percent)).drop("x", "y"))
        ids = likely.select(F.col("ia").alias("id")).unionByName(likely.select(F.col("ib").alias("id"))).distinct()
        wanted = self.sc.broadcast(bit_table(ids, "id", ID_BITS))
        counted = overlaps(likely.select("a", "b"), segments(self.docs, self.width, self.fragments, wanted), self.fragments)
        found = settle(counted.join(likely, ["a", "b"]).where(F.col("common") * 100 >= (F.col("m") + F.col("n") - F.col("common")) * self.percent).select("a", "b", "common", "ia", "ib"))
        wanted.unpersist()
        return found

    def parts(self, links: DataFrame) -> DataFrame:
        """key, part: the smallest id of each class's component."""
        found = components(links.select(F.col("ia").alias("a"), F.col("ib").alias("b")))
        return self.slim.join(found, "id", "left").select("key", F.coalesce("component", "id").alias("part"))


def ngram_links(docs: DataFrame, width: int = 5, percent: int = 80, fragments: int = FRAGMENTS) -> tuple[Join, DataFrame, DataFrame]:
    """The join, its links between classes (a spanning part of them within a component), and each class's component."""
    join = Join(docs, width, percent, fragments)
    posts = join.postings()
    first = settle(join.met_hubs(posts))
    links = join.confirmed(first)
    parts = settle(join.parts(links))
    rest = join.met_apart(posts, parts).join(first, ["a", "b"], "left_anti")
    links = links.unionByName(join.confirmed(rest))
    return join, links, settle(join.parts(links))


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80, fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: confirmed links of the document's set, and its further copies."""
    join, links, parts = ngram_links(docs, width, percent, fragments)
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    found = join.slim.select("key", "copies").join(parts, "key").join(degree, "key", "left")
    rows = join.signed.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    out = rows.join(found, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("part", "doc_id").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))
