"""Language identification by a bidirectional gated recurrent network over bytes, trained here with numpy.

Each direction is a GRU over UTF-8 bytes. Every position gets a probability for every language from both states;
a document's probabilities are the means over its positions, its prediction is the largest (ties: the first name) and
its score that mean. Texts are read whole, in segments of SEGMENT bytes that run side by side. Before a segment each
direction reads the WARM bytes that lead to it, so that states don't start empty inside a text; memory and the number
of steps don't depend on the length of a text.

Training: ``sample`` labelled documents, those with the smallest hashes, at most (equal rows count once), with their whole texts, cut into
pieces of PIECE bytes; ``epochs`` passes over all pieces, more if those are fewer than ``steps`` minibatches; cross-entropy
at every position, backpropagation through time, Adam. All seeds are fixed, so reruns agree. The model has a few
thousand numbers and is sent to the executors with the task.

Null or empty texts and texts without a letter (Unicode category L) are ``und`` with score 0. Null languages are never learnt from. With
nothing to learn from every document is ``und``. Repeated rows get the same answer each. An empty table gives an empty
result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_hash, map_arrow, quiet_threads, task_batches

SEGMENT, WARM, WIDTH, PIECE = 512, 64, 8, 64
AT_ONCE = 1 << 18
GATES = ("z", "r", "c")


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Gru:
    """One direction. keep: the states and gates that the backward pass needs."""

    def __init__(self, rng: np.random.Generator, width: int):
        self.p = {f"e{g}": rng.normal(0, 0.3, (256, width)).astype(np.float32) for g in GATES} | {f"u{g}": rng.normal(0, width**-0.5, (width, width)).astype(np.float32) for g in GATES}
        self.p["ez"] -= 1  # slow to forget at first

    def run(self, x: np.ndarray, mask: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
        """x: steps by rows, bytes; the states after each step."""
        p, (steps, rows) = self.p, x.shape
        width = p["uz"].shape[0]
        h, out = np.zeros((rows, width), np.float32), np.empty((steps, rows, width), np.float32)
        for t in range(steps):
            i = x[t]
            z = p["ez"].take(i, axis=0)
            z += h @ p["uz"]
            r = p["er"].take(i, axis=0)
            r += h @ p["ur"]
            sigmoid(z)
            sigmoid(r)
            c = p["ec"].take(i, axis=0)
            c += (r * h) @ p["uc"]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, z, r, c))
            if mask is not None:
                z *= mask[t][:, None]
            new = c - h
            new *= z
            new += h
            out[t] = h = new
        return out

    def back(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        p, grads = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        d_h = np.zeros_like(d_out[0])
        d_gates = {g: np.empty_like(d_out) for g in GATES}
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, c = kept[t]
            d_h = d_h + d_out[t]
            d_c = d_h * z * (1 - c * c)
            d_z = d_h * (c - h) * z * (1 - z)
            d_rh = d_c @ p["uc"].T
            d_r = d_rh * h * r * (1 - r)
            grads["uc"] += (r * h).T @ d_c
            grads["uz"] += h.T @ d_z
            grads["ur"] += h.T @ d_r
            d_h = d_h * (1 - z) + d_rh * r + d_z @ p["uz"].T + d_r @ p["ur"].T
            d_gates["z"][t], d_gates["r"][t], d_gates["c"][t] = d_z, d_r, d_c
        for g in GATES:
            np.add.at(grads[f"e{g}"], x.ravel(), d_gates[g].reshape(-1, d_out.shape[-1]))
        return grads


class Network:
    def __init__(self, names: list[str], seed: int = 7, width: int = WIDTH):
        rng = np.random.default_rng(seed)
        self.names, self.ahead, self.behind = names, Gru(rng, width), Gru(rng, width)
        self.w = rng.normal(0, 0.1, (2 * width, len(names))).astype(np.float32)
        self.b = np.zeros(len(names), np.float32)

    def probabilities(self, x: np.ndarray, mask: np.ndarray | None = None, kept: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """x: steps by rows. Probabilities (steps, rows, languages) and the joined states."""
        a = self.ahead.run(x, mask, kept and kept[0])
        b = self.behind.run(x[::-1], None if mask is None else mask[::-1], kept and kept[1])[::-1]
        width = a.shape[-1]
        logits = a @ self.w[:width]
        logits += b @ self.w[width:]
        logits += self.b
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits, (a, b)

    def fit(self, x: np.ndarray, held: np.ndarray, y: np.ndarray, steps: int = 240, epochs: int = 1, rows: int = 256, rate: float = 0.02, seed: int = 11) -> None:
        """x: rows by bytes, held: how many bytes of each row there are, y: the languages' numbers."""
        rng = np.random.default_rng(seed)
        each = -(-len(x) // rows)
        steps = each * max(epochs, -(-steps // each))
        order = np.concatenate([rng.permutation(len(x)) for _ in range(steps // each)])
        batches = [at for epoch in np.split(order, steps // each) for at in np.array_split(epoch, each)]
        params = {("a", k): v for k, v in self.ahead.p.items()} | {("b", k): v for k, v in self.behind.p.items()} | {("w", ""): self.w, ("v", ""): self.b}
        first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
        for step, at in enumerate(batches, 1):
            block, kept = np.ascontiguousarray(x[at].T).astype(np.intp), ([], [])
            mask = (np.arange(len(block))[:, None] < held[at][None, :]).astype(np.float32)
            prob, (a, b) = self.probabilities(block, mask, kept)
            prob[:, np.arange(len(at)), y[at]] -= 1
            prob *= mask[:, :, None] / mask.sum()
            width = a.shape[-1]
            grads = {("w", ""): np.concatenate([np.tensordot(s, prob, ((0, 1), (0, 1))) for s in (a, b)]), ("v", ""): prob.sum((0, 1))}
            grads |= {("a", k): v for k, v in self.ahead.back(block, kept[0], prob @ self.w[:width].T).items()}
            grads |= {("b", k): v for k, v in self.behind.back(block[::-1], kept[1], (prob @ self.w[width:].T)[::-1]).items()}
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            scale, pace = min(1.0, 1.0 / (norm + 1e-9)), rate * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = g * scale
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                params[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over the positions of each text (not empty)."""
        lengths = np.array([len(t) for t in texts])
        starts = np.concatenate(([0], np.cumsum(lengths)))
        data = np.frombuffer(b"".join(texts), np.uint8)
        number = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), number)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * SEGMENT
        # Of each segment: first and last byte with what leads to it on either side, and the segment itself.
        low, high = np.maximum(at - WARM, 0), np.minimum(at + SEGMENT + WARM, lengths[doc])
        begin, end = at - low, np.minimum(at + SEGMENT, lengths[doc]) - low
        held = high - low
        sums = np.zeros((len(doc), len(self.names)))
        order = np.argsort(held, kind="stable")
        for some in np.array_split(order, max(1, -(-len(doc) * (SEGMENT + 2 * WARM) // AT_ONCE))):
            if not len(some):
                continue
            steps = np.arange(held[some].max())[:, None]
            block = data[np.minimum(starts[doc[some]] + low[some] + steps, len(data) - 1)].astype(np.intp)
            mask = None if held[some].min() == len(steps) else (steps < held[some]).astype(np.float32)
            prob, _ = self.probabilities(block, mask)
            prob *= ((steps >= begin[some]) & (steps < end[some])).astype(np.float32)[:, :, None]
            sums[some] = prob.sum(0)
        out = np.zeros((len(texts), len(self.names)))
        np.add.at(out, doc, sums)
        return out / lengths[:, None]


def pieces_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces of PIECE bytes of all texts, the last of each filled up with zeros: bytes, lengths, text."""
    number = np.array([-(-len(t) // PIECE) for t in texts])
    x = np.frombuffer(b"".join(t.ljust(int(n) * PIECE, b"\0") for t, n in zip(texts, number, strict=True)), np.uint8).reshape(-1, PIECE)
    held = np.full(len(x), PIECE)
    held[np.cumsum(number) - 1] = [len(t) - (int(n) - 1) * PIECE for t, n in zip(texts, number, strict=True)]
    return x, held, np.repeat(np.arange(len(texts)), number)


def fit_language(labelled: DataFrame, sample: int = 1500) -> Network | None:
    """From doc_id, text, lang; None if there is nothing to learn from."""
    quiet_threads()
    known = labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("doc_id", "text", "lang").alias("h"), "text")
    rows = by_hash(known, sample).collect()  # `sample` rows
    names = sorted({r["lang"] for r in rows})
    if not names:
        return None
    network = Network(names)
    if len(names) > 1:
        x, held, of = pieces_of([r["text"].encode() for r in rows])
        network.fit(x, held, np.array([names.index(r["lang"]) for r in rows])[of])
    return network


def with_language(docs: DataFrame, network: Network | None) -> DataFrame:
    """All columns of docs and lang_pred, score (columns of those names are replaced)."""
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    keep = [f.name for f in fields]
    docs = docs.select(*[F.col(f"`{name}`") for name in keep])

    def label(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in task_batches(batches, "gru_language"):
            n = batch.num_rows
            names, scores = ["und"] * n, [0.0] * n
            for at, texts in chunks(batch.column("text")):
                for i, p in zip(at, network.documents(texts), strict=True):
                    k = int(p.argmax())
                    names[i], scores[i] = network.names[k], min(1.0, float(p[k]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    if network is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "lang_pred string", "score double"])
    return docs.transform(map_arrow, label, schema)


def chunks(column, most: int = 1 << 21) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows with a letter and their bytes, about two megabytes at a time."""
    at, texts, size = [], [], 0
    for i, value in enumerate(column):
        text = value.as_py()
        if text and any(map(str.isalpha, text)):
            at.append(i)
            texts.append(text.encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= most:
                yield at, texts
                at, texts, size = [], [], 0
    if at:
        yield at, texts
