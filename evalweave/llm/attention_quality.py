"""Document quality by attention-based multiple-instance learning (Ilse et al., 2018), in numpy.

A document is a bag of passages of PASSAGE bytes; only the document has a label. Every passage is described by how
often pairs of neighbouring byte classes occur in it (letters, digits, spaces, kinds of punctuation, parts of UTF-8
characters) and by the share of different 4-byte strings, which falls when text repeats. An
encoder turns that into a vector, a gated attention (tanh times sigmoid) weighs the passages of the document, and a
logistic unit scores the weighted mean vector. Encoder, attention and unit are learnt together from document labels.

Training: the ``sample`` labelled documents with the smallest hashes of id, at most, with all their passages; this bound
is a parameter of the fit alone. Scoring reads every passage of every document, some passages at a time: of a very long
text 136 bytes are kept for each passage. Seeds are fixed, so reruns agree. The model has some thousand numbers.

Null and empty texts are one passage without content. Null labels are never learnt from; of several labels of one id
the mean counts, and a tie means 1. With nothing to learn from, the score is 0.5. Repeated rows get the same score. An
empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_hash, map_arrow, quiet_threads, task_batches

PASSAGE, HIDDEN, AT_ONCE = 512, 16, 1 << 20
KINDS = 16
EXTRA = 2
GAP = bytes(4)
#: Byte -> class.
CLASS = np.full(256, 15, np.uint8)
for kind, members in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".", b",;:", b"!?", b"|", b"\"'()[]{}<>", b"#$%&*@^~+=", b"-_/\\")):
    CLASS[list(members)] = kind
CLASS[0x80:0xC0] = 13
CLASS[0xC0:] = 14


def features(passages: list[bytes]) -> np.ndarray:
    """A row for each passage. Four zero bytes stand before each, so that nothing depends on its neighbours."""
    held = np.array([len(p) for p in passages])
    data = np.frombuffer(GAP + GAP.join(passages) + GAP, np.uint8)
    n, row = len(passages), np.repeat(np.arange(len(passages), dtype=np.int64), held + len(GAP))
    kind = CLASS[data]
    pair = (row << 8) + ((kind[: len(row)] << 4) | kind[1 : len(row) + 1])
    counts = np.bincount(pair, minlength=n * KINDS * KINDS).reshape(n, -1)
    out = np.empty((n, KINDS * KINDS + EXTRA), np.float32)
    out[:, : KINDS * KINDS] = np.sqrt(counts / np.maximum(held, 1)[:, None])
    # Different 4-byte strings, by a 11-bit hash.
    b = data.astype(np.uint32)
    grams = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    grams = (grams[: len(row)] * np.uint32(2654435761)) >> np.uint32(21)
    seen = np.zeros(n << 11, bool)
    seen[(row << 11) + grams] = True
    out[:, -2] = seen.reshape(n, -1).sum(1) / np.maximum(held, 1)
    out[:, -1] = held / PASSAGE
    return out


def cut(text: bytes) -> list[bytes]:
    return [text[i : i + PASSAGE] for i in range(0, max(1, len(text)), PASSAGE)]


class Attention:
    def __init__(self, seed: int = 5):
        rng, d = np.random.default_rng(seed), KINDS * KINDS + EXTRA
        draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        self.p = {"w": draw(d, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, HIDDEN), "u": draw(HIDDEN, HIDDEN), "a": draw(HIDDEN), "o": draw(HIDDEN), "c": np.zeros(1)}
        self.mean, self.scale = np.zeros(d), np.ones(d)

    def score(self, x: np.ndarray, number: np.ndarray, keep: dict | None = None) -> np.ndarray:
        x = (x - self.mean) * self.scale
        h, t, s, raw = self.encode(x)
        return self.pool(h, raw, number, keep, x=x, t=t, s=s)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Vectors of passages, the two halves of their gates and their attention before it is shared out."""
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        return h, t, s, (t * s) @ p["a"]

    def pool(self, h: np.ndarray, raw: np.ndarray, number: np.ndarray, keep: dict | None = None, **more: np.ndarray) -> np.ndarray:
        p, start = self.p, np.concatenate(([0], np.cumsum(number)[:-1]))
        e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, start), number))
        weight = e / np.repeat(np.add.reduceat(e, start), number)
        z = np.add.reduceat(h * weight[:, None], start)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))
        if keep is not None:
            keep.update(h=h, weight=weight, z=z, start=start, **more)
        return y

    def fit(self, x: np.ndarray, number: np.ndarray, y: np.ndarray, rounds: int = 30, rows: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0, dtype=np.float64), 1 / (x.std(0, dtype=np.float64) + 0.02)
        share = np.clip(y.mean(), 0.02, 0.98)
        self.p["c"][:] = np.log(share / (1 - share))
        starts = np.concatenate(([0], np.cumsum(number)))
        first, second, step = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, 0
        first, second = first
        total = rounds * -(-len(y) // rows)
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for some in np.array_split(order, -(-len(y) // rows)):
                step += 1
                k, at = {}, np.concatenate([np.arange(starts[i], starts[i + 1]) for i in some])
                n = number[some]
                d = (self.score(x[at], n, k) - y[some]) / len(some)
                p, h, w = self.p, k["h"], k["weight"]
                d_z = np.repeat(np.outer(d, p["o"]), n, 0)
                d_w = (d_z * h).sum(1)
                d_raw = w * (d_w - np.repeat(np.add.reduceat(w * d_w, k["start"]), n))
                d_t, d_s = np.outer(d_raw, p["a"]) * k["s"], np.outer(d_raw, p["a"]) * k["t"]
                d_t, d_s = d_t * (1 - k["t"] ** 2), d_s * k["s"] * (1 - k["s"])
                d_h = (d_z * w[:, None] + d_t @ p["v"].T + d_s @ p["u"].T) * (1 - h * h)
                g = {"o": k["z"].T @ d, "c": np.array([d.sum()]), "a": (k["t"] * k["s"]).T @ d_raw, "v": h.T @ d_t, "u": h.T @ d_s, "w": k["x"].T @ d_h, "b": d_h.sum(0)}
                pace = rate * (1 - step / (total + 1))
                for name, grad in g.items():
                    grad = grad + decay * p[name]
                    first[name] += 0.1 * (grad - first[name])
                    second[name] += 0.01 * (grad * grad - second[name])
                    p[name] -= pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        bags = [cut(t) for t in texts]
        flat, per = [p for bag in bags for p in bag], AT_ONCE // PASSAGE
        parts = [self.encode((features(flat[i : i + per]) - self.mean) * self.scale) for i in range(0, len(flat), per)]
        return self.pool(np.concatenate([x[0] for x in parts]), np.concatenate([x[3] for x in parts]), np.array([len(bag) for bag in bags]))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Attention | None:
    """docs: doc_id, text. labels: doc_id, quality; only rows that may be learnt from."""
    quiet_threads()
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = by_hash(known.withColumn("h", F.xxhash64("doc_id")), sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "h", F.md5(F.coalesce("text", F.lit(""))).alias("m"), "text").toArrow().sort_by([("h", "ascending"), ("m", "ascending")])  # `sample` ids at most
    if not rows.num_rows:
        return None
    bags = [cut((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in rows.column("text")]
    parts = [p for bag in bags for p in bag]
    model = Attention()
    model.fit(np.concatenate([features(parts[i : i + 2048]) for i in range(0, len(parts), 2048)]), np.array([len(bag) for bag in bags]), rows.column("quality").to_numpy().astype(float))
    return model


def with_quality(docs: DataFrame, model: Attention | None) -> DataFrame:
    """All columns of docs and score (a column of that name is replaced)."""
    keep = [f for f in docs.schema.fields if f.name != "score"]
    if model is None:
        return docs.select(*[F.col(f"`{f.name}`") for f in keep], F.lit(0.5).alias("score"))

    def rate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in task_batches(batches, "attention_quality"):
            scores = [model.documents(texts) for texts in groups(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*[f.name for f in keep], "score"])

    return docs.select(*[F.col(f"`{f.name}`") for f in keep]).transform(map_arrow, rate, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], "score double"]))


def groups(column, most: int = AT_ONCE) -> Iterator[list[bytes]]:
    some, size = [], 0
    for value in column:
        some.append((value.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(some[-1])
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some
