"""Invertible Bloom lookup sketches of documents' paragraphs, in DataFrame operations only.

A document is the set of its paragraphs' digests: lines, cut again behind every sentence and table cell, so that an
edit moves no other cuts. A digest is 39 bits of a hash and a checksum of those in the low 24 bits. A sketch is 2^level
blocks of 3 sub-tables of CELLS cells. The top bits of a digest choose its block, other bits one cell of each sub-table;
a cell is the xor of its digests. Two sketches of one size subtract cell by cell: what both hold cancels. A cell whose
checksum fits shows one digest; taking it out of its other cells shows more (peeling). If all cells end empty, the
differing digests are known, and so is the likeness |A and B| / |A or B|.

A document's fingerprint is its sketch with a block for PER_BLOCK digests, so it grows with the text. The fingerprints
of a pair are subtracted where they have one size; else, and for each block in which peeling fails, the sketch is drawn
again twice as large (a block becomes two, by the next bit), until it peels. Blocks that peeled are done, so a retry
costs what is left. Different digests differ in a bit that chooses a block or cell, so this ends. Work grows with n log n
for a text of n paragraphs, in one task.

Pairs here are a document with an edited version and with the next document, in descending order of id, the first
following the last. Neighbours are found on narrow rows dealt by range; texts are shuffled once, and parts of next
texts a second time.

Null texts count as empty; a text without paragraphs has an empty sketch, and two of them are alike (1.0). Null ids
come last; of rows with one id (a tie), the order is that of the MD5 of their texts; rows that repeat id and text are one
document and get the same values. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

CELLS, PER_BLOCK = 4, 8
CHECK_BITS = 24
CHECK, KEY = (1 << CHECK_BITS) - 1, (1 << 63) - (1 << CHECK_BITS)
#: The first bit that chooses a block; those below the last such bit choose cells.
TOP_BIT, LEVELS = 62, 33
#: End marks that a space follows, and those of scripts without spaces; what may close behind them.
MARKS, WIDE, CLOSE = ".!?…؟۔।॥։።|", "。！？｡", "\"'”’»)\\]」』）"
#: A line ends a paragraph, and so does white space behind a table cell or sentence.
PARAGRAPH_END = rf"\n+|(?=\s)(?:(?<=[{MARKS}])|(?<=[{MARKS}][{CLOSE}]))\s+|(?:(?<=[{WIDE}])|(?<=[{WIDE}][{CLOSE}]))(?![{WIDE}{CLOSE}])\s*"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def check(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(long(CHECK))


def digests(text: Column) -> Column:
    keys = F.transform(F.filter(F.split(text, PARAGRAPH_END), lambda p: p != ""), lambda p: F.xxhash64(p).bitwiseAND(long(KEY)))
    return F.array_distinct(F.transform(keys, lambda k: k.bitwiseOR(check(k))))


def xor_of(members: Column) -> Column:
    return F.aggregate(members, long(0), lambda x, y: x.bitwiseXOR(y))


def places() -> list[tuple[int, int]]:
    """For each cell of a block, the bits of a digest that choose it and their value."""
    width = CELLS.bit_length() - 1
    return [((CELLS - 1) << (CHECK_BITS + width * j), i << (CHECK_BITS + width * j)) for j in range(3) for i in range(CELLS)]


def in_cells(members: Column) -> list[Column]:
    """The xor of the members of each cell; members is an attribute or a lambda's variable, as it is read for each."""

    def one(bits: int, value: int) -> Column:
        return xor_of(F.filter(members, lambda d: d.bitwiseAND(long(bits)) == long(value)))

    return [one(bits, value) for bits, value in places()]


def block(members: Column) -> Column:
    return F.array(*in_cells(members))


def halves(members: Column, level: Column) -> list[Column]:
    """The members by the bit that makes two blocks of one of this level."""

    def half(bit: int) -> Column:
        return F.filter(members, lambda d: F.getbit(d, F.lit(TOP_BIT) - level) == bit)

    return [half(0), half(1)]


def level_of(number: Column) -> Column:
    """The least level with a block for PER_BLOCK digests."""
    return F.when(number <= PER_BLOCK, F.lit(0)).otherwise(F.ceil(F.log2(number / F.lit(float(PER_BLOCK)))).cast("int"))


def blocks(members: Column, level: Column) -> Column:
    """The members in their 2^level blocks."""
    steps = F.when(level > 0, F.sequence(F.lit(0), level - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(members), lambda lists, at: F.flatten(F.transform(lists, lambda x: F.array(*halves(x, at)))))


def sketch(dealt: Column) -> Column:
    return F.transform(dealt, block)


def peel(cells: Column) -> Column:
    """How many digests differ, from the cells of a subtracted block; null if peeling gets stuck."""

    def pure(x: Column) -> Column:
        return (x != 0) & (x.bitwiseAND(long(CHECK)) == check(x.bitwiseAND(long(KEY))))

    def step(state: Column, _: Column) -> Column:
        def taken(shown: Column) -> Column:
            left = F.array(*[F.get(state["cells"], F.lit(i)).bitwiseXOR(x) for i, x in enumerate(in_cells(shown))])
            return F.when(F.size(shown) == 0, F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("going"))).otherwise(
                F.struct(left.alias("cells"), (state["found"] + F.size(shown)).alias("found"), F.lit(True).alias("going"))
            )

        return F.when(~state["going"], state).otherwise(let(F.array_distinct(F.filter(state["cells"], pure)), taken))

    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"), F.lit(True).alias("going"))
    done = F.aggregate(F.array(*[F.lit(i) for i in range(3 * CELLS)]), start, step)
    return let(done, lambda s: F.when(F.forall(s["cells"], lambda x: x == 0), s["found"]))


def difference(a: str, b: str) -> Column:
    """Struct of found, the digests in one of two lists only, and tries, the number of sizes that it took.

    Columns <a> and <b> are lists, <a>_level, <a>_dealt and <a>_sketch are its level, blocks and sketch.
    """
    level = F.greatest(f"{a}_level", f"{b}_level")
    same = F.col(f"{a}_level") == F.col(f"{b}_level")

    def opened(members: Column) -> Column:
        return F.struct(members.alias("members"), block(members).alias("cells"))

    subtracted = F.zip_with(
        F.zip_with(f"{a}_dealt", f"{b}_dealt", lambda x, y: F.concat(x, y)),
        F.zip_with(f"{a}_sketch", f"{b}_sketch", lambda x, y: F.zip_with(x, y, lambda v, w: v.bitwiseXOR(w))),
        lambda members, cells: F.struct(members.alias("members"), cells.alias("cells")),
    )
    drawn = F.transform(blocks(F.concat(a, b), level), opened)
    start = F.struct(F.when(same, subtracted).otherwise(drawn).alias("open"), F.lit(0).alias("found"), F.when(same, F.lit(0)).otherwise(F.lit(1)).alias("tries"))

    def attempt(state: Column, step: Column) -> Column:
        def after(tried: Column) -> Column:
            stuck = F.filter(tried, lambda x: x["found"].isNull())
            children = F.flatten(F.transform(stuck, lambda x: F.transform(F.array(*halves(x["members"], level + step)), opened)))
            found = F.aggregate(tried, state["found"], lambda n, x: n + F.coalesce(x["found"], F.lit(0)))
            return F.struct(children.alias("open"), found.alias("found"), (state["tries"] + 1).alias("tries"))

        tried = F.transform(state["open"], lambda x: F.struct(x["members"].alias("members"), peel(x["cells"]).alias("found")))
        return F.when(F.size(state["open"]) == 0, state).otherwise(let(tried, after))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS) - level), start, attempt)


def likeness(a: str, b: str, differ: Column) -> Column:
    held = F.size(a) + F.size(b)
    return F.when(held == 0, F.lit(1.0)).otherwise((held - differ) / (held + differ))


def written(cells: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each cell."""
    return F.array_join(F.transform(F.flatten(cells), lambda x: F.lpad(F.hex(x), 16, "0")), "")


def neighbours(docs: DataFrame) -> DataFrame:
    """k, take (a third of the text) and the next document's next_k; docs: k, doc_id, text."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = docs.select("k", "doc_id", F.floor(F.length("text") / 3).cast("int").alias("take")).distinct()
    dealt = settle(keys.repartitionByRange(parts, F.col("doc_id").desc_nulls_last(), "k").withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), "k")
    rows = dealt.withColumn("next_k", F.lead("k").over(here)).withColumn("rank", F.row_number().over(here))
    # The first of each part, and which part follows: a row for each part.
    over = Window.orderBy("part")
    first = rows.where("rank = 1").select("part", F.col("k").alias("first"))
    follow = first.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return rows.join(F.broadcast(follow), "part").select("k", "take", F.coalesce("next_k", "after").alias("next_k"))


def compare_versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digests(text).alias("p"))
    asked = settle(neighbours(docs)).select(F.col("next_k").alias("k"), F.col("k").alias("for_k"), "take")
    given = (
        docs.join(asked, "k")
        .select(F.col("for_k").alias("k"), F.substring("text", F.lit(1), F.col("take")).alias("head"), "take", F.col("doc_id").alias("next_id"), F.col("p").alias("q"))
        .dropDuplicates(["k"])
    )
    # Both joins take the same columns of docs (next_id is the first one's), so that texts are shuffled once for both.
    pairs = docs.join(given, "k").withColumn("n_chars", F.length("text"))
    edited = pairs.select("doc_id", "next_id", "n_chars", "p", "q", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - F.col("take")), "head").alias("edited"))
    hashed = edited.select("doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "p", digests(F.col("edited")).alias("e"), "q")
    sized = hashed.withColumns({f"{c}_level": level_of(F.size(c)) for c in ("p", "e", "q")})
    dealt = sized.withColumns({f"{c}_dealt": blocks(F.col(c), F.col(f"{c}_level")) for c in ("p", "e", "q")})
    drawn = dealt.withColumns({f"{c}_sketch": sketch(F.col(f"{c}_dealt")) for c in ("p", "e", "q")})
    compared = drawn.withColumns({"edited": difference("p", "e"), "next": difference("p", "q")})
    return compared.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", written(F.col("p_sketch")).alias("fingerprint"), written(F.col("e_sketch")).alias("edited_fingerprint"),
        likeness("p", "e", F.col("edited.found")).alias("near_edited"), likeness("p", "q", F.col("next.found")).alias("near_next"),
        F.col("edited.tries").alias("edited_tries"), F.col("next.tries").alias("next_tries"), "next_id",
    )
