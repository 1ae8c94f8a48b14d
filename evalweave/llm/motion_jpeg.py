"""Motion-JPEG in AVI as a media column: lossless storage of bytes, reading back, and shots as timed clip rows.

Storage. 64 bytes are the 64 quantised coefficients of an 8 x 8 block: the DC coefficient is the byte, an AC
coefficient is the byte plus one, so that none is zero and no runs occur. Frames are baseline JPEG, one component,
all quantisers one, with Huffman tables of their own in which the code of size class s has 10 - s bits: with its s
value bits every coefficient takes 10 bits. Coefficients are what JPEG codes without loss, so nothing is lost.
Up to 64 blocks are one frame, 8 pixels wide; more are frames of 64 x 64 pixels, the last filled up with zero bytes.
The file is RIFF: header list with stream header and format, an INFO comment with the number of blocks, the frames and
an index, in which the reader finds the frames.

Reading. Frames come from the index; each is parsed by its markers, its Huffman tables are built from what it says,
and its words are decoded by table. This reads the files written here (10-bit words; any tables that give those), and
refuses other JPEG frames with an error. Pixels are the inverse DCT in whole numbers, so equal files give equal pixels.

Shots. Frames have histograms of 16 grey levels; a frame starts a new clip if the difference to the frame before is
above the mean and two standard deviations of the differences in the WINDOW frames before it, and above FLOOR. The
second frame, with no differences before it, starts one above FIRST.

Null and empty texts are one block of zero bytes. Repeated rows get the same values. An empty table gives an empty
result. Other columns of the input are ignored. A task holds one Arrow batch and GROUP bytes (or one longer text).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, task_batches

BLOCK, FRAME_BLOCKS, WORD_BITS, RATE = 64, 64, 10, 25
WINDOW, FLOOR, FIRST, LEVELS = 12, 0.05, 0.2, 16
GROUP = 1 << 20
#: The order in which JPEG lists the coefficients of a block: by diagonals, up and down in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def size_class(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def codes(sizes: list[int]) -> dict[int, int]:
    """Canonical Huffman codes for size classes, each WORD_BITS less its size long."""
    out, code, last = {}, 0, 0
    for s in sorted(sizes, key=lambda s: WORD_BITS - s):
        length = WORD_BITS - s
        code <<= length - last
        out[s], last = code, length
        code += 1
    return out


def word_table(low: int, high: int, sizes: list[int]) -> np.ndarray:
    """The word of each value from low to high."""
    values = np.arange(low, high + 1)
    s = size_class(values)
    code = codes(sizes)
    bits = np.where(values < 0, values + (1 << s) - 1, values)
    return np.array([code[int(k)] << int(k) | int(b) for k, b in zip(s, bits, strict=True)], np.uint64)


DC_SIZES, AC_SIZES = list(range(9)), list(range(1, 10))
DC_WORDS, AC_WORDS = word_table(-255, 255, DC_SIZES), word_table(1, 256, AC_SIZES)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_segment(table: int, sizes: list[int]) -> bytes:
    order = sorted(sizes, key=lambda s: WORD_BITS - s)
    counts = [sum(WORD_BITS - s == n for s in sizes) for n in range(1, 17)]
    return segment(0xC4, bytes([table, *counts, *order]))


TABLES = segment(0xDB, b"\0" + b"\1" * 64) + huffman_segment(0x00, DC_SIZES) + huffman_segment(0x10, AC_SIZES)


def jpeg_head(width: int, height: int) -> bytes:
    return b"\xff\xd8" + TABLES + segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)) + segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def scans(blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """10 bytes for 8 coefficients of all blocks; first: whether a block starts a frame. Not stuffed yet."""
    words = AC_WORDS[blocks]
    dc = blocks[:, 0].astype(np.int64)
    before = np.concatenate(([0], dc[:-1]))
    words[:, 0] = DC_WORDS[dc - np.where(first, 0, before) + 255]
    four = words.reshape(-1, 4)
    packed = four[:, 0] << np.uint64(30) | four[:, 1] << np.uint64(20) | four[:, 2] << np.uint64(10) | four[:, 3]
    return packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(len(blocks), -1)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], width: int, height: int, blocks: int) -> bytes:
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"blocks=%d" % blocks))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    movie = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames))
    return chunk(b"RIFF", b"AVI " + head + info + movie + chunk(b"idx1", b"".join(index)))


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as an AVI file."""
    plans, parts, starts = [], [], []
    for data in payloads:
        n = len(data) // BLOCK
        per = n if n <= FRAME_BLOCKS else FRAME_BLOCKS
        frames = -(-n // per)
        plans.append((n, per, frames))
        parts.append(data + bytes((frames * per - n) * BLOCK))
        starts.append(np.arange(frames * per) % per == 0)
    coded = scans(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, BLOCK), np.concatenate(starts))
    out, at = [], 0
    for n, per, frames in plans:
        width, height = (8, 8 * n) if n <= FRAME_BLOCKS else (64, 64)
        head = jpeg_head(width, height)
        made = []
        for _ in range(frames):
            made.append(head + coded[at : at + per].tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9")
            at += per
        out.append(avi(made, width, height, n))
    return out


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def open_avi(data: bytes) -> tuple[list[bytes], int, int]:
    """Frames by the index, microseconds for each frame, and the number of blocks of the payload."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    pace = blocks = movie = 0
    frames: list[bytes] = []
    for name, a, b in chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        kind = data[a : a + 4]
        if name == b"LIST" and kind == b"hdrl":
            pace = next(struct.unpack_from("<I", data, x)[0] for n, x, _ in chunks(data, a + 4, b) if n == b"avih")
        elif name == b"LIST" and kind == b"INFO":
            blocks = next(int(data[x:y].partition(b"=")[2]) for n, x, y in chunks(data, a + 4, b) if n == b"ICMT")
        elif name == b"LIST" and kind == b"movi":
            movie = a
        elif name == b"idx1":
            for at in range(a, b, 16):
                offset, size = struct.unpack_from("<II", data, at + 8)
                frames.append(data[movie + offset + 8 : movie + offset + 8 + size])
    return frames, pace, blocks


_DECODERS: dict[bytes, np.ndarray] = {}


def decoder(body: bytes) -> np.ndarray:
    """From a Huffman segment: the value of each 10-bit word; words that end early or late are refused."""
    if body not in _DECODERS:
        counts, symbols = body[1:17], iter(body[17:])
        table = np.full(1 << WORD_BITS, 1 << 20, np.int64)
        code = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                s = next(symbols)
                if length + s != WORD_BITS:
                    raise ValueError("a code of another length")
                bits = np.arange(1 << s)
                table[(code << s) + bits] = np.where(bits >= 1 << s >> 1, bits, bits - (1 << s) + 1) if s else 0
                code += 1
            code <<= 1
        _DECODERS[body] = table
    return _DECODERS[body]


def parse_frame(frame: bytes) -> tuple[int, int, bytes, np.ndarray, np.ndarray]:
    """Width, height, entropy-coded bytes (not stuffed), and the two decoders."""
    at, tables, size = 2, {}, (0, 0)
    while True:
        marker, length = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC4:
            tables[body[0]] = decoder(body)
        elif marker == 0xC0:
            size = struct.unpack_from(">HH", body, 1)
        elif marker == 0xDA:
            break
    return size[1], size[0], frame[at:-2].replace(b"\xff\0", b"\xff"), tables[0x00], tables[0x10]


def coefficients(scan: np.ndarray, first: np.ndarray, dc_table: np.ndarray, ac_table: np.ndarray) -> np.ndarray:
    """Blocks of coefficients from rows of 80 bytes; first: whether a block starts a frame."""
    five = scan.reshape(-1, 5).astype(np.int64)
    packed = five[:, 0] << 32 | five[:, 1] << 24 | five[:, 2] << 16 | five[:, 3] << 8 | five[:, 4]
    words = np.stack([packed >> s & 1023 for s in (30, 20, 10, 0)], 1).reshape(-1, BLOCK)
    out = ac_table[words]
    step = dc_table[words[:, 0]]
    total = np.cumsum(step)
    base = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    out[:, 0] = total - (total - step)[base]
    return out


def inverse_dct() -> np.ndarray:
    """Coefficients (in zigzag order) to pixels, times 2^16, in whole numbers."""
    k = np.arange(8)
    c = np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    full = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * 65536)


INVERSE = inverse_dct()


def histograms(coefs: np.ndarray, frame: np.ndarray, frames: int) -> np.ndarray:
    """Counts of 16 grey levels in each frame. Sums of whole numbers below 2^53: exact in any order."""
    pixels = np.clip(np.floor((coefs.astype(np.float64) @ INVERSE + 32768) / 65536) + 128, 0, 255).astype(np.int64) >> 4
    return np.bincount((frame[:, None] * LEVELS + pixels).ravel(), minlength=frames * LEVELS).reshape(frames, LEVELS)


def shot_starts(hist: np.ndarray) -> list[int]:
    share = hist / hist.sum(1, keepdims=True)
    steps = np.abs(np.diff(share, axis=0)).sum(1) / 2
    starts = [0]
    for i in range(len(steps)):
        past = steps[max(0, i - WINDOW) : i]
        if steps[i] > (max(FLOOR, past.mean() + 2 * past.std()) if i else FIRST):
            starts.append(i + 1)
    return starts


def read_back(files: list[bytes]) -> list[tuple[bytes, int, list[tuple[int, int, int]], np.ndarray]]:
    """Of each file: payload, frames, clips (first frame, frames, microseconds a frame) and the histogram of all."""
    rows, plans = [], []
    of_frame: list[tuple[np.ndarray, np.ndarray]] = []
    for data in files:
        frames, pace, blocks = open_avi(data)
        per = 0
        for f in frames:
            width, height, scan, dc, ac = parse_frame(f)
            per = width * height // BLOCK
            of_frame.append((dc, ac))
            if len(scan) != per * BLOCK * WORD_BITS // 8:
                raise ValueError("a frame of another size")
            rows.append(scan)
        plans.append((len(frames), per, blocks, pace))
    first = np.concatenate([np.arange(n * per) % per == 0 for n, per, _, _ in plans])
    # Frames in a row that share their tables are decoded together.
    turns = [i for i, t in enumerate(of_frame) if not i or t[0] is not of_frame[i - 1][0] or t[1] is not of_frame[i - 1][1]]
    begin = np.flatnonzero(first)
    parts = []
    for i, j in zip(turns, [*turns[1:], len(rows)], strict=True):
        here = slice(begin[i], begin[j] if j < len(rows) else len(first))
        parts.append(coefficients(np.frombuffer(b"".join(rows[i:j]), np.uint8), first[here], *of_frame[i]))
    coefs = np.concatenate(parts) if len(parts) > 1 else parts[0]
    number = np.cumsum(first) - 1
    hist = histograms(coefs, number, int(number[-1]) + 1)
    coefs[:, 1:] -= 1
    data = coefs.astype(np.uint8)
    out, block, frame = [], 0, 0
    for n, per, blocks, pace in plans:
        mine = hist[frame : frame + n]
        starts = shot_starts(mine)
        out.append((data[block : block + blocks].tobytes(), n, [(a, b - a, pace) for a, b in zip(starts, [*starts[1:], n], strict=True)], mine.sum(0)))
        block, frame = block + n * per, frame + n
    return out


def in_groups(values: list, size) -> Iterator[list[int]]:
    some, total = [], 0
    for i, v in enumerate(values):
        some.append(i)
        total += size(v)
        if total >= GROUP:
            yield some
            some, total = [], 0
    if some:
        yield some


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text's bytes as an AVI file."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in task_batches(batches, "motion_jpeg"):
            texts = batch.column("text")
            for at in in_groups(texts, lambda t: t.as_buffer().size if t.is_valid else 0):
                data = [(texts[i].as_py() or "").encode("utf-8", "surrogatepass") for i in at]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(list(map(len, data)), pa.int64()), pa.array(store([padded(d) for d in data]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, run, "doc_id long, n_bytes long, media binary")


CLIP = "array<struct<clip:int,first_frame:int,frames:int,start_s:double,end_s:double>>"


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored bytes say: payload digests, media digests, clips, feature."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        clip = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
        for batch in task_batches(batches, "motion_jpeg"):
            files = batch.column("media").to_pylist()
            for at in in_groups(files, len):
                got = read_back([files[i] for i in at])
                payloads = [g[0] for g in got]
                clips = [[(k, a, n, a * pace / 1e6, (a + n) * pace / 1e6) for k, (a, n, pace) in enumerate(g[2])] for g in got]
                features = [f"frames={g[1]};clips={len(g[2])};starts={hashlib.sha256(repr([c[0] for c in g[2]]).encode()).hexdigest()[:16]};levels={','.join(map(str, (g[3] * 1000 // g[3].sum()).tolist()))}" for g in got]
                pick = pa.array(at)
                cols = [
                    batch.column("doc_id").take(pick), batch.column("n_bytes").take(pick), pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    pa.array([len(files[i]) for i in at], pa.int64()), pa.array([hashlib.sha256(files[i]).hexdigest() for i in at]), pa.array(features, pa.string()), pa.array(clips, clip),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"])

    return media.select("doc_id", "n_bytes", "media").transform(map_arrow, run, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips {CLIP}")


def clip_rows(read: DataFrame) -> DataFrame:
    """A row for each clip: doc_id, clip, first_frame, frames, start_s, end_s."""
    return read.select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")
