"""Best-fit packing of tokenised documents into sequences, with large items matched in pairs first.

1. Every document becomes token ids and an end id; one longer than a sequence is cut into full pieces and a rest.
2. Pieces are counted by length. There are at most ``capacity`` lengths, so this table has a proven bound and one
   process can pack it, whatever the number of documents: equal lengths are placed many at a time.
3. Large-item matching: of lengths above a third of a sequence at most two fit (but for three of exactly a third,
   which are small). From the longest down, each is paired with the longest other large one that still fits.
4. Smaller lengths, longest first, go where they fit best: into the narrowest gap that takes them, else into a new
   sequence. A gap that is still wide enough takes more of the same length, as it is then the narrowest.
5. The plan is a list of moves "ranks r0.. of length l go to sequences b0.., k in each, from offset o". A piece finds
   its move by its length and its rank among pieces of that length; ranks come from 64 hash cells for each length, so
   that a length that many documents share doesn't meet in a task.

Null and empty texts are one end id. Repeated rows are packed like any others. An empty table gives an empty result.
Other columns of the input are ignored. Token pieces are computed once, kept as a checkpoint, and no task keeps more
than one Arrow batch of texts and a word cache of at most ``CACHE`` entries.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash32, keeps, map_arrow, quiet_threads, settle, task_batches

#: Words kept, characters of a word that is kept, words encoded in a call, characters of texts that are split at once.
CACHE, CACHED_CHARS, MISSES, AT_ONCE = 600_000, 48, 4096, 2_000_000
#: ASCII punctuation but for the apostrophe, which begins endings of its own.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def lowered(text: str) -> str:
    """Lower case, which the tokenizer asks for anyway, where no rule looks at more than a letter."""
    return text.lower() if is_latin(text) else text


class WordIds:
    """Ids of texts, as little-endian 32-bit words, for a tokenizer that drops white space and never joins words.

    As no token spans a space, a text's ids are those of its space-separated parts in a row; parts recur. A part of
    lower-case Latin-1 letters only is one word to the tokenizer and normal already: such parts are encoded many at a
    time without normalizer, split at white space only, and each ends at an end-of-word token. Other
    parts go through the whole tokenizer, one by one.
    """

    def __init__(self, path: str):
        quiet_threads()
        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.plain = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, texts: list[str], how: tuple) -> list:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = how
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def meet(self, parts: list[str]) -> None:
        """Learn new parts; a word with marks behind it is that word's ids and the marks', as those are one run."""
        tails = {p: word for p in parts if (word := p.rstrip(MARKS)) != p and word.isalnum()}
        new = {tails.get(p, p) for p in parts}.union({p[len(word) :] for p, word in tails.items()}).difference(self.known)
        words = [p for p in new if p.isalpha()]
        together = " ".join(words)
        if not (together == lowered(together) and is_latin(together)):
            words = [p for p in words if p == lowered(p) and is_latin(p)]
        for i in range(0, len(words), MISSES):
            self.learn(words[i : i + MISSES])
        rest = list(new.difference(self.known))
        for i in range(0, len(rest), MISSES):
            self.learn_any(rest[i : i + MISSES])
        known = self.known
        known.update({p: known[word] + known[p[len(word) :]] for p, word in tails.items()})

    def learn(self, words: list[str]) -> None:
        import numpy as np

        ids = np.array(self.encode([" ".join(words)], self.plain)[0].ids, "<u4")
        stops = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
        if len(stops) != len(words):
            self.learn_any(words)
            return
        data = ids.tobytes()
        self.known.update(zip(words, [data[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)], strict=True))

    def learn_any(self, parts: list[str]) -> None:
        import numpy as np

        for part, got in zip(parts, self.encode(parts, self.whole), strict=True):
            self.known[part] = np.array(got.ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [lowered(text).replace("\n", " ").split(" ") for text in texts]
        if len(self.known) > CACHE:
            self.known = {"": b""}
        missing = list(set().union(*split).difference(self.known))
        if missing:
            self.meet(missing)
        out = [b"".join(map(self.known.__getitem__, parts)) for parts in split]
        for p in missing:
            if len(p) > CACHED_CHARS:
                del self.known[p]
        return out

    def stream(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of any number of texts, some texts at a time."""
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from self.ids(some)
                some, size = [], 0
        yield from self.ids(some)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each worker process, so that what it has learnt serves the next tasks too."""
    return WordIds(path)


keeps("packing", word_ids.cache_clear)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, end = word_ids(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in task_batches(batches, "packing"):
            out: list[tuple] = []
            texts = (text.as_py() or "" for text in batch.column("text"))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.stream(texts), strict=True):
                ids += end
                out += [(doc, k, k * capacity, len(part := ids[at : at + 4 * capacity]) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), 4 * capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").transform(map_arrow, cut, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Moves (length, first rank, number, first sequence, number in each sequence, offset)."""
    left = {length: n for length, n in counts.items() if n > 0}
    used: dict[int, int] = defaultdict(int)  # ranks given out, by length
    moves: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs of sequences (first, number)
    widths: list[int] = []

    def move(length: int, n: int, first: int, each: int, offset: int) -> None:
        moves.append((length, used[length], n, first, each, offset))
        used[length] += n

    def free(width: int, first: int, n: int) -> None:
        if width and n:
            if width not in gaps:
                insort(widths, width)
            gaps[width].append((first, n))

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at >= 0 and large[at] == a and left[a] < 2:
            at -= 1
        b = large[at] if at >= 0 else None
        n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
        move(a, n, bins, 1, 0)
        left[a] -= n
        if b is not None:
            move(b, n, bins, 1, a)
            left[b] -= n
        free(capacity - a - (b or 0), bins, n)
        bins += n
        for x in {a, b} - {None}:
            if not left[x]:
                large.pop(bisect_left(large, x))

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[length]
        while n:
            at = bisect_left(widths, length)
            if at == len(widths):
                each = capacity // length
                new = -(-n // each)
                free(capacity, bins, new)
                bins += new
                at = bisect_left(widths, length)
            width = widths[at]
            first, number = gaps[width].pop()
            if not gaps[width]:
                del gaps[width]
                widths.pop(at)
            each = width // length
            full = min(number, n // each)
            if full:
                move(length, full * each, first, each, capacity - width)
                free(width - each * length, first, full)
                n -= full * each
            if full < number:
                if n and n < each:
                    move(length, n, first + full, n, capacity - width)
                    free(width - n * length, first + full, 1)
                    n, full = 0, full + 1
                free(width, first + full, number - full)
    return moves


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(settle(pieces_of(docs, tokenizer_path, capacity, end_id)), capacity)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """sequence_id and offset for rows with doc_id, piece, length, ids_crc32; other columns stay."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    return assign(pieces, plan_bins(counts, capacity), spark)


def assign(pieces: DataFrame, moves: Iterable[tuple], spark) -> DataFrame:
    schema = "m_length long, r0 long, n long, first long, each long, m_offset long"
    plan = spark.createDataFrame(list(moves), schema)
    celled = pieces.withColumn("cell", (hash32(F.col("doc_id"), F.col("piece")) % 64).cast("int"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = celled.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n_cell")).withColumn("cell_from", F.coalesce(F.sum("n_cell").over(before), F.lit(0))).drop("n_cell")
    in_cell = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = celled.withColumn("in_cell", F.row_number().over(in_cell) - 1).join(starts, ["length", "cell"]).withColumn("rank", F.col("cell_from") + F.col("in_cell"))
    # The plan has a few rows for each of at most `capacity` lengths and gap widths.
    at = (F.col("length") == F.col("m_length")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r0") + F.col("n"))
    i = F.col("rank") - F.col("r0")
    return ranked.join(F.broadcast(plan), at).select(
        *pieces.columns,
        F.expr("first + (rank - r0) div each").alias("sequence_id"),
        (F.col("m_offset") + (i % F.col("each")) * F.col("length")).alias("offset"),
    )
