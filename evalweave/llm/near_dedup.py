"""Near-duplicate documents by bottom-k sketches from one hash function, confirmed by exact Jaccard.

A document is the set of its distinct word shingles, each one 64-bit hash. Its sketch keeps the k smallest hashes, so
one hash function makes the sketch, the sketch of a union is the k smallest of both sketches, and the share of that
union sketch that both hold estimates the Jaccard similarity.

1. Signatures: documents with equal sets form a class, whose smallest id stands for it from here on.
2. Retained values are counted over all documents. Bit tables of fixed size record values held twice or more and
   values held as often as each step of HOT says. A wrong bit costs time, never a link.
3. Inverted lists. Values of a sketch are put in one order for all documents: rare before hot, step by step, then by
   hash, so that a value that many hold is listed only by texts that have little else. If two
   sketches must share at least ``need`` values, their first ``size - need + 1`` values in that order share one, so
   only those are listed. For a set of at most k shingles the sketch is the set and the bound is exact; beyond that
   ``need`` is k * similarity less five standard deviations (a miss has a chance below 1 in 10^6 at the threshold), and
   never more than for whole sets.
4. Links in two phases. First each list is paired with one hub, the member with the earliest place, which is linear in
   the lists. Confirmed pairs give components. Then pairs of list members that are still in different components are
   compared, list by list and size class by size class, if sizes (and places, for whole sets) leave room for enough
   overlap; sets of classes further apart can't link. A pair inside one component can't change the result,
   so nothing is lost and a group of thousands of copies doesn't make its square of pairs.
5. A pair is confirmed on the full sets, once the union-sketch estimate has thrown out pairs that are far off: first
   on the SMALL smallest values, which every document's signature carries, then on the whole sketches. Only documents
   of pairs that pass send their full sets.

Null ids: such rows link with nothing and have a null component. Null or empty texts: an empty set, linked with
nothing. Rows that share an id are one node. Ties: the smallest id wins. An empty table gives an empty result. Other
columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle, task_batches
from .components import components
from .shingles import U, distinct, mix, shingle_sets

K = 256
#: Values that this many documents retain are ordered behind those that fewer do, step by step.
HOT = (8, 64, 512, 4096, 32768, 262144)
#: Values, cut to 32 bits, of the sketch that goes with a signature.
SMALL = 128
SHARED_BITS, HOT_BITS, ID_BITS = 26, 24, 24


def need_of(size: int, percent: int) -> int:
    """Values that the sketch of a set of this size must share with that of any set it may link with."""
    exact = -(-percent * size // 100)
    if size * 100 <= K * percent:  # no partner has more than K shingles
        return exact
    t = percent / 100
    return min(exact, math.floor(K * t - 5 * math.sqrt(K * t * (1 - t))))


def bit_at(table: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    at = mix(values) >> U(64 - bits)
    return (table[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0


def steps_of(tables: list[np.ndarray], values: np.ndarray, bits: int) -> np.ndarray:
    """For each value the number of tables that hold it."""
    at = mix(values) >> U(64 - bits)
    word, bit = (at >> U(3)).astype(np.int64), (at & U(7)).astype(np.uint8)
    found = np.zeros(len(values), np.uint8)
    for table in tables:
        found += (table[word] >> bit) & 1
    return found


def bit_table(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of 2^bits bits with the place of each value set: at most 2^bits / 64 rows reach the driver."""

    def places(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in task_batches(batches, "shingles"):
            at = mix(batch.column(0).to_numpy(zero_copy_only=False).view(U)) >> U(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> U(6)).astype(np.int64)), pa.array((U(1) << (at & U(63))).view(np.int64))], names=["word", "bits"])

    words = values.select(F.col(column)).transform(map_arrow, places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint8)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (s1, s2) and the head of its sketch."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in task_batches(batches, "shingles"):
            n, one, two, small = [], [], [], []
            for s in shingle_sets((x.as_py() for x in batch.column("text")), width):
                n.append(len(s))
                one.append(int(mix(s).sum(dtype=U)))
                two.append(int(np.bitwise_xor.reduce(mix(s ^ U(0x5DEECE66D))) if len(s) else 0))
                small.append((s[:SMALL] >> U(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *[pa.array(np.array(x, U).view(np.int64)) for x in (one, two)], pa.array(small, pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "small"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, sign, "doc_id long, n_shingles long, s1 long, s2 long, small binary")


def retained(docs: DataFrame, width: int) -> DataFrame:
    """A row for each value that a document's sketch retains."""

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in task_batches(batches, "shingles"):
            for some in blocks(shingle_sets((x.as_py() for x in batch.column("text")), width)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some).view(np.int64))], names=["value"])

    def blocks(sets: Iterator[np.ndarray], most: int = 200_000) -> Iterator[list[np.ndarray]]:
        some, n = [], 0
        for s in sets:
            some.append(s[:K])
            n += len(some[-1])
            if n >= most:
                yield some
                some, n = [], 0
        if n:
            yield some

    return docs.select("text").transform(map_arrow, keep, "value long")


def postings(docs: DataFrame, width: int, percent: int, shared, hot) -> DataFrame:
    """value, class id (smallest doc_id), set size, and the value's place in the sketch's order."""

    def post(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["value", "n", "s1", "s2", "place", "doc_id"]
        for batch in task_batches(batches, "shingles"):
            some, rows = [], 0

            def out(some: list) -> pa.RecordBatch:
                cols = [np.concatenate(c) for c in zip(*some, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names=names)

            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets((x.as_py() for x in batch.column("text")), width), strict=True):
                if not len(s) or doc is None:
                    continue
                sketch = s[:K]
                order = sketch[np.argsort(steps_of(hot.value, sketch, HOT_BITS), kind="stable")][: len(sketch) - need_of(len(s), percent) + 1]
                at = np.flatnonzero(bit_at(shared.value, order, SHARED_BITS))
                if len(at):
                    fill = np.full(len(at), 0, np.int64)
                    s1, s2 = mix(s).sum(dtype=U), np.bitwise_xor.reduce(mix(s ^ U(0x5DEECE66D)))
                    some.append((order[at], fill + len(s), np.full(len(at), s1, U), np.full(len(at), s2, U), at + 1, fill + doc))
                    rows += len(at)
                if rows > 100_000:
                    yield out(some)
                    some, rows = [], 0
            if some:
                yield out(some)

    rows = docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, post, "value long, n long, s1 long, s2 long, place long, doc_id long")
    return rows.groupBy("value", "n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.min("place").cast("int").alias("place")).select("value", F.col("n").cast("int").alias("n"), "place", "id")


def full_sets(docs: DataFrame, width: int, wanted) -> DataFrame:
    """id and the sorted set, as bytes, of documents whose id may be wanted."""

    def emit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in task_batches(batches, "shingles"):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            known = ~np.array([x is None for x in batch.column("doc_id").to_pylist()], bool)
            at = np.flatnonzero(known)
            at = at[bit_at(wanted.value, ids[at].astype(np.int64).view(U), ID_BITS)] if len(at) else at
            text = batch.column("text")
            some, size = [], 0
            for i, s in zip(at.tolist(), shingle_sets((text[j].as_py() for j in at.tolist()), width), strict=True):
                some.append((int(ids[i]), s.tobytes()))
                size += 8 * len(s)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.binary())], names=["id", "shingles"])
                    some, size = [], 0
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.binary())], names=["id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, emit, "id long, shingles binary")


def far_off(x: np.ndarray, y: np.ndarray, k: int, percent: int) -> bool:
    """Whether the union sketch of k values puts a pair five standard deviations below the threshold."""
    union = distinct(np.concatenate((x[:k], y[:k])))[:k]
    both = len(np.intersect1d(np.intersect1d(union, x[:k]), y[:k]))
    t = percent / 100
    return both < len(union) * t - 5 * math.sqrt(len(union) * t * (1 - t))


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the heads of the sketches don't rule out."""

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in task_batches(batches, "shingles"):
            x, y = ([np.frombuffer(v, "<u4") for v in batch.column(k).to_pylist()] for k in (2, 3))
            keep = pa.array([not far_off(p, q, SMALL, percent) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    left = classes.select(F.col("id").alias("a"), F.col("small").alias("x"))
    right = classes.select(F.col("id").alias("b"), F.col("small").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").transform(map_arrow, look, "a long, b long").distinct()


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Union-sketch estimate first, then exact."""
    if (len(x) > K or len(y) > K) and far_off(x, y, K, percent):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar enough."""

    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in task_batches(batches, "shingles"):
            a, b, x, y = (batch.column(k) for k in range(4))
            keep = [linked(np.frombuffer(x[i].as_buffer(), U), np.frombuffer(y[i].as_buffer(), U), percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (a, b)], names=["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").transform(map_arrow, check, "a long, b long")


def room(percent: int):
    """Condition: sizes and places of the first common value leave room for enough overlap (m, p and n, q).

    All earlier values of either are not in the other. For whole sets that bounds the overlap. Sketches of which one
    document holds the other's text differ in up to 2 * (K - need_of) values, all of which may come first; the length
    of the listed prefixes says the same, so places rule out nothing more there.
    """
    small, large = F.least("m", "n"), F.greatest("m", "n")
    left = F.least(F.col("m") - F.col("p"), F.col("n") - F.col("q")) + 1
    return (small * 100 >= large * percent) & ((large > K) | (left * (100 + percent) >= (F.col("m") + F.col("n")) * percent))


def size_class(percent: int):
    """Class of a set's size n: sets that may link are in the same class or in neighbouring ones.

    A class spans a little more than the ratio of sizes that the threshold allows, so rounding can't put two apart.
    """
    return F.floor(F.log("n") / max(math.log(100 / percent) * (1 + 1e-9), 0.01)).cast("int")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links (confirmed links of its class that were needed or met)."""
    sc = docs.sparkSession.sparkContext
    signed = settle(signatures(docs, width))
    classes = settle(signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "s1", "s2", "small").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")))

    counts = settle(retained(docs, width).groupBy("value").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    shared = sc.broadcast(bit_table(counts, "value", SHARED_BITS))
    often = settle(counts.where(F.col("held") >= HOT[0]))
    hot = sc.broadcast([bit_table(often.where(F.col("held") >= least), "value", HOT_BITS) for least in HOT])
    posts = settle(postings(docs, width, percent, shared, hot))
    for table in (shared, hot):
        table.unpersist()

    hubs = posts.groupBy("value").agg(F.min_by(F.struct("id", "n", "place"), F.struct("place", "id")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    met = posts.join(hubs, "value").select(F.col("hub.id").alias("u"), F.col("hub.n").alias("m"), F.col("hub.place").alias("p"), F.col("id").alias("v"), "n", F.col("place").alias("q")).where("u <> v").where(room(percent))
    first = settle(met.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = settle(likely(pairs, classes, percent))
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        wanted = sc.broadcast(bit_table(ids, "id", ID_BITS))
        found = settle(confirm(pairs, full_sets(docs, width, wanted), percent))
        wanted.unpersist()
        return found

    links = confirmed(first)
    parts = settle(components(links))
    labelled = posts.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    mixed = labelled.groupBy("value").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("value")
    # Each document's open lists in the common order; a pair is made in the first list that both are in, and no other.
    held = labelled.join(mixed, "value").groupBy("id", "n", "part").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("lists"))
    members = held.select("id", "n", "part", F.col("lists.value").alias("values"), F.posexplode("lists").alias("at", "list")).select("id", "n", "part", size_class(percent).alias("sizes"), "list.place", "list.value", F.slice("values", 1, F.col("at")).alias("before"))
    # A set meets its own class (each pair once, by id) and the next larger one, which also splits a long list.
    x = members.select("value", F.explode(F.array(F.lit(0), F.lit(1))).alias("up"), "sizes", F.col("id").alias("u"), F.col("n").alias("m"), F.col("place").alias("p"), F.col("part").alias("part_u"), F.col("before").alias("before_u")).withColumn("sizes", F.col("sizes") + F.col("up"))
    y = members.select("value", "sizes", F.col("id").alias("v"), "n", F.col("place").alias("q"), F.col("part").alias("part_v"), F.col("before").alias("before_v"))
    apart = ((F.col("up") == 1) | (F.col("u") < F.col("v"))) & (F.col("part_u") != F.col("part_v")) & room(percent) & ~F.arrays_overlap("before_u", "before_v")
    rest = x.join(y, ["value", "sizes"]).where(apart).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).join(first, ["a", "b"], "left_anti")
    more = confirmed(rest)
    links = links.unionByName(more)
    parts = settle(components(links))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))

    found = settle(classes.join(parts, "id", "left").join(degree, "id", "left").select("n_shingles", "s1", "s2", F.coalesce("component", "id").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies"))
    out = signed.drop("small").alias("d").join(found.alias("c"), F.expr("d.n_shingles = c.n_shingles and d.s1 = c.s1 and d.s2 = c.s2 and d.doc_id is not null"), "left")
    component = F.coalesce("c.component", "d.doc_id")
    return out.select("d.doc_id", "d.n_shingles", component.alias("component_id"), F.coalesce(F.col("d.doc_id") == component, F.lit(True)).alias("kept"), (F.coalesce("c.n_links", F.lit(0)) + F.coalesce("c.copies", F.lit(1)) - 1).alias("n_links"))
