"""Probabilities of texts under a context tree of the training documents, beside a word-count baseline.

Grams (context and byte) and words (lower case A-Z) travel as sorted lists of 64-bit keys with counts, packed into
one binary value for each list and bucket, so that Spark moves lists and not a row for each gram. The bucket of a gram
comes from its nearest TOP bytes, that of a word from its hash; there is one for every BUCKET bytes of text.

1. Each task counts its training texts; each bucket sums the lists. Sums for the nodes of TOP - 1 bytes of context, of
   which there are at most 256^TOP, go to the driver, which computes the short contexts from them.
2. Texts are dealt to chunks of about CHUNK bytes. A chunk sends its different keys, with its training counts, to the
   buckets. A bucket has then both the training counts of all chunks and the keys that chunks ask for; it computes its
   part of the tree with all its nodes, and sends log probabilities and word counts back to each chunk, in order.
3. The chunk, joined with its texts, adds up grams and words of each text. Word counts are exact.

Null texts count as empty (an end token only); a null id counts as an empty string where ids decide what is learnt.
Rows that repeat id and text get the same values each. With nothing to learn from, the model gives each decision one
half. A very long text is a chunk of its own. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import context_tree as tree
from .common import dropping_shuffles, map_arrow, task_batches, tidy
from .shingles import U, distinct, groups_of, mix, word_hashes

#: Different keys that a task or chunk holds before it packs them.
HELD = 2_000_000
#: Bytes of text that are looked up together, and for which there is a bucket.
CHUNK, BUCKET = 8 << 20, 4 << 20
#: Small corpora are dealt to as many chunks and buckets as Spark shuffles to, if each still has so many bytes.
LEAST = 1 << 20
WORDS, GRAMS = 0, 1
LISTS = "bucket int, chunk int, kind int, keys binary, counts binary"


def packed(values: np.ndarray) -> bytes:
    """Integers by planes of bytes, which compress well; keys of a list as differences."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=U(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, U), dtype=U)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their counts."""
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = tree.runs(key)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def keys_of(kind: int, group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a group of texts, and where each text starts (words: one more at the end)."""
    return word_hashes(group) if kind == WORDS else tree.grams_of(group)


def by_bucket(kind: int, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its keys, in ascending order of bucket and then key; keys are sorted."""
    part = keys if kind == WORDS else keys >> U(8 * (tree.DEPTH + 1 - tree.TOP))
    bucket = (mix(part + U(kind)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for at in np.split(order, tree.runs(bucket[order])[1:]) if len(order) else []:
        yield int(bucket[at[0]]), at


def count_lists(buckets: int):
    def count(batches: Iterator) -> Iterator:
        held: dict[int, list] = {WORDS: [], GRAMS: []}

        def out(kind: int) -> Iterator:
            keys, n = summed(held[kind])
            held[kind] = []
            yield from lists(kind, 0, keys, n, buckets)

        for batch in task_batches(batches, "shingles"):
            for group in groups_of(x.as_py() for x in batch.column("text")):
                for kind in held:
                    held[kind].append(np.unique(keys_of(kind, group)[0], return_counts=True))
                    if sum(len(x[0]) for x in held[kind]) > HELD:
                        held[kind] = [summed(held[kind])]
                        if len(held[kind][0][0]) > HELD // 2:
                            yield from out(kind)
        for kind in held:
            if held[kind]:
                yield from out(kind)

    return count


def lists(kind: int, chunk: int, keys: np.ndarray, n: np.ndarray, buckets: int) -> Iterator:
    """Rows of LISTS for sorted keys and their counts."""
    import pyarrow as pa

    rows = [(bucket, chunk, kind, packed_keys(keys[at]), packed(n[at].astype(np.uint32))) for bucket, at in by_bucket(kind, keys, buckets)]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), kinds, strict=True)], names=["bucket", "chunk", "kind", "keys", "counts"])


def lists_in(table, kind: int) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """Chunks and their keys and counts, of one kind."""
    rows = [(c, unpacked_keys(k), unpacked(n, np.uint32).astype(np.int64)) for c, t, k, n in zip(*(table.column(x).to_pylist() for x in ("chunk", "kind", "keys", "counts")), strict=True) if t == kind]
    return [r[0] for r in rows], [r[1:] for r in rows]


def bucket_sums(table):
    """Sums for nodes of TOP - 1 bytes of context; under the name -1 the training words and the different ones."""
    import pyarrow as pa

    tidy()
    columns = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, np.float64)]
    _, words = lists_in(table, WORDS)
    if words:
        keys, n = summed(words)
        for c, x in zip(columns, (-1, n.sum(), len(keys), 0.0), strict=True):
            c.append(np.array([x]))
    _, grams = lists_in(table, GRAMS)
    if grams:
        name, *sums = tree.Grams(*summed(grams)).partial()
        for c, x in zip(columns, (name.view(np.int64), *sums), strict=True):
            c.append(x)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.Table.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(columns, kinds, strict=True)], names=["name", "zeros", "ones", "mixed"])


def top_sums(docs: DataFrame, buckets: int) -> list[np.ndarray]:
    """What all buckets say of the training texts (bucket_sums): 256^TOP rows at most."""
    counted = docs.select("text").transform(map_arrow, count_lists(buckets), LISTS)
    sums = counted.groupBy("bucket").applyInArrow(bucket_sums, "name long, zeros long, ones long, mixed double")
    top = sums.groupBy("name").agg(F.sum("zeros"), F.sum("ones"), F.sum("mixed")).toArrow().sort_by([("name", "ascending")])
    return [top.column(i).to_numpy() for i in range(4)]


def text_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), held_out.alias("held_out"))
    found = docs.agg(F.count_if(~F.col("held_out")).alias("texts"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    least = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), found["bytes"] // LEAST)
    texts, (chunks, buckets) = found["texts"], (max(1, least, -(-found["bytes"] // size)) for size in (CHUNK, BUCKET))

    with dropping_shuffles(docs.sparkSession):
        name, zeros, ones, mixed = top_sums(docs.where(~F.col("held_out")), buckets)
    of_words = name < 0
    total, different = int(zeros[of_words].sum()) + texts, int(ones[of_words].sum()) + (texts > 0)
    short = sc.broadcast(tree.Short(name[~of_words].astype(U), zeros[~of_words], ones[~of_words], mixed[~of_words]))
    scale, end = float(total + different + 1), math.log10((texts + 1) / (total + different + 1))

    def wanted(table):
        import pyarrow as pa

        tidy()
        chunk, out = table.column("chunk")[0].as_py(), []
        learnt = np.array([not x.as_py() for x in table.column("held_out")], bool)
        for kind in (WORDS, GRAMS):
            parts, first = [], 0
            for group in groups_of(x.as_py() for x in table.column("text")):
                keys, at = keys_of(kind, group)
                of = np.repeat(learnt[first : first + len(group)], np.diff(at if kind == WORDS else np.append(at, len(keys))))
                unique, n = np.unique(keys[of], return_counts=True)
                parts += [(unique, n), (other := distinct(keys[~of]), np.zeros(len(other), np.int64))]
                first += len(group)
                if sum(len(p[0]) for p in parts[1:]) > HELD // 2:
                    parts = [summed(parts)]
            out += lists(kind, chunk, *summed(parts), buckets)
        return pa.Table.from_batches(out) if out else pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})

    def look_up(table):
        import pyarrow as pa

        tidy()
        bucket, rows = table.column("bucket")[0].as_py(), []
        for kind in (WORDS, GRAMS):
            of, held = lists_in(table, kind)
            if not held:
                continue
            keys, n = summed(held)
            values = n.astype(np.float64) if kind == WORDS else tree.Grams(keys, n).log2(short.value)
            rows += [(chunk, kind, bucket, packed(values[np.searchsorted(keys, asked)].astype(np.float32 if kind == GRAMS else np.float64))) for chunk, (asked, _) in zip(of, held, strict=True)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "kind", "bucket", "found"])

    def add_up(table, answers):
        import pyarrow as pa

        tidy()
        answered = sorted(zip(*(answers.column(k).to_pylist() for k in ("kind", "bucket", "found")), strict=True), key=lambda r: r[:2])
        columns = []
        for kind in (WORDS, GRAMS):
            parts = []
            for group in groups_of(x.as_py() for x in table.column("text")):
                unique, at = np.unique((keys := keys_of(kind, group))[0], return_inverse=True)
                parts.append((unique, at.ravel().astype(np.int32), keys[1]))
            all_keys = np.zeros(0, U)
            for i in range(0, len(parts), 4):
                all_keys = distinct(np.concatenate([all_keys, *[p[0] for p in parts[i : i + 4]]]))
            given = np.zeros(len(all_keys))
            found = [unpacked(data, np.float64 if kind == WORDS else np.float32) for k, _, data in answered if k == kind]
            if len(all_keys):
                given[np.concatenate([at for _, at in by_bucket(kind, all_keys, buckets)])] = np.concatenate(found)
            done = []
            for unique, at, starts in parts:
                value = given[np.searchsorted(all_keys, unique)]
                if kind == GRAMS:
                    done.append((np.add.reduceat(value[at], starts),))
                    continue
                n = len(starts) - 1
                doc = np.repeat(np.arange(n), np.diff(starts))
                done.append((np.diff(starts) + 1, np.bincount(doc, weights=value[at] > 0, minlength=n).astype(np.int64) + (texts > 0), np.bincount(doc, weights=np.log10((value + 1) / scale)[at], minlength=n) + end))
            columns += [np.concatenate(c) for c in zip(*done, strict=True)]
        n_tokens, n_known, base, logs = columns
        kept = [table.column(k) for k in ("doc_id", "held_out")]
        return pa.Table.from_arrays([*kept, *[pa.array(c) for c in (n_tokens, n_known, np.full(len(base), total, np.int64), base, logs * math.log10(2))]], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    chunked = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    asked = chunked.groupBy("chunk").applyInArrow(wanted, LISTS)
    answers = asked.groupBy("bucket").applyInArrow(look_up, "chunk int, kind int, bucket int, found binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add_up, schema)
