"""Clips: durations, excerpts, sampled frames, audio. Decoding needs ffmpeg and runs beside the file, in a UDF.

The command that runs a program can be passed in, so that everything but the decoder itself is tested without one.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Run = Callable[[list[str]], bytes]
#: Sample rate, seconds of audio that are read, least samples, how far an excerpt's length may be off.
AUDIO_RATE, AUDIO_SECONDS, LEAST_SAMPLES, EXCERPT_TOLERANCE = 16000, 300, 1600, 0.25
PROBE = "struct<streams:array<struct<codec_type:string,duration:string>>,format:struct<duration:string>>"


def run_program(command: list[str], seconds: int = 240) -> bytes:
    return subprocess.run(command, check=True, capture_output=True, timeout=seconds).stdout


def probe_duration(probe_json: Column) -> Column:
    """Seconds, from a probe's JSON: the video stream's, else the container's; without audio an error."""
    p = F.from_json(probe_json, PROBE)
    kind = lambda k: F.filter(p["streams"], lambda s: s["codec_type"] == k)
    seconds = F.coalesce(F.get(kind("video"), F.lit(0))["duration"], p["format"]["duration"]).cast("double")
    sound = (F.size(kind("audio")) > 0) & (F.size(kind("video")) > 0)
    return F.when(sound, seconds).otherwise(F.raise_error(F.lit("no audio or no video stream")).cast("double"))


def probes(clips: DataFrame, root: str, run: Run = run_program) -> DataFrame:
    """clips: qid, clip_path. qid, duration."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [run(["ffprobe", "-v", "error", "-show_streams", "-show_format", "-of", "json", os.path.join(root, p)]).decode() for p in rows["clip_path"]]
            yield pd.DataFrame({"qid": rows["qid"], "probe": out})

    return clips.select("qid", "clip_path").mapInPandas(look, "qid string, probe string").select("qid", probe_duration(F.col("probe")).alias("duration"))


def excerpt(source: str, start: float, end: float, run: Run = run_program) -> dict:
    """A re-encoded part of a clip (lossless video, 16-bit PCM), checked against the length asked for."""
    if not 0 <= start < end or end - start > 12.001:
        raise ValueError("an excerpt has at most 12 seconds")
    with tempfile.TemporaryDirectory() as folder:
        target = os.path.join(folder, "window.mov")
        run(["ffmpeg", "-nostdin", "-v", "error", "-threads", "2", "-ss", str(start), "-i", source, "-t", str(end - start), "-map", "0:v:0", "-map", "0:a:0", "-sn", "-dn", "-c:v", "libx264", "-preset", "ultrafast", "-crf", "0", "-threads", "2", "-c:a", "pcm_s16le", "-map_metadata", "-1", "-y", target])
        found = json.loads(run(["ffprobe", "-v", "error", "-show_streams", "-show_format", "-of", "json", target]))
        video = next(s for s in found["streams"] if s["codec_type"] == "video")
        seconds = float(video.get("duration", found["format"]["duration"]))
        if abs(seconds - (end - start)) >= EXCERPT_TOLERANCE:
            raise ValueError(f"an excerpt of {seconds} seconds")
        with open(target, "rb") as f:
            content = f.read()
    return {"requested_window": [start, end], "decoded_duration_seconds": seconds, "excerpt_sha256": hashlib.sha256(content).hexdigest(), "content": content}


def read_audio(path: str, run: Run = run_program) -> tuple[np.ndarray, dict]:
    """Mono samples of the first 300 seconds; too few, or any that isn't finite, is an error."""
    raw = run(["ffmpeg", "-nostdin", "-v", "error", "-threads", "2", "-i", path, "-t", str(AUDIO_SECONDS), "-map", "0:a:0", "-vn", "-ac", "1", "-ar", str(AUDIO_RATE), "-f", "f32le", "pipe:1"])
    samples = np.frombuffer(raw, np.float32)
    if len(samples) < LEAST_SAMPLES or not np.isfinite(samples).all():
        raise ValueError("invalid audio")
    return samples, {"audio_window_start": 0, "audio_seconds_supplied": len(samples) / AUDIO_RATE, "audio_sha256": hashlib.sha256(samples.tobytes()).hexdigest()}


def audio_snippets(samples: np.ndarray) -> tuple[np.ndarray, dict]:
    """Eight two-second parts, evenly spaced, in a row, and zeros up to 30 seconds."""
    from ..functions.numeric import PADDED_SECONDS, SNIPPET_SECONDS, SNIPPETS

    starts = np.linspace(0, max(0, len(samples) / AUDIO_RATE - SNIPPET_SECONDS), SNIPPETS)
    parts = np.concatenate([samples[int(s * AUDIO_RATE) : int(s * AUDIO_RATE) + int(SNIPPET_SECONDS * AUDIO_RATE)] for s in starts])
    if len(parts) > PADDED_SECONDS * AUDIO_RATE:
        raise ValueError("too much audio")
    return np.pad(parts, (0, PADDED_SECONDS * AUDIO_RATE - len(parts))), {"audio_snippet_starts_seconds": starts.tolist(), "audio_seconds_encoded": len(parts) / AUDIO_RATE, "audio_native_padded_seconds": PADDED_SECONDS}


def sampled_frames(clips: DataFrame, read: Callable[[str], tuple[int, float, Callable[[list[int]], np.ndarray]]]) -> DataFrame:
    """clips: qid, path. Frame numbers, times and digest; read gives total, rate and a reader of frames by number."""
    from ..functions.numeric import FRAMES_PER_SECOND, LEAST_FRAMES, MOST_FRAMES

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for qid, path in zip(rows["qid"], rows["path"], strict=True):
                total, rate, frames = read(path)
                if total < 2 or not np.isfinite(rate) or rate <= 0:
                    raise ValueError("invalid video")
                count = int(min(max(total / rate * FRAMES_PER_SECOND, LEAST_FRAMES), MOST_FRAMES, total)) // 2 * 2
                at = np.rint(np.linspace(0, total - 1, count)).astype(int).tolist()
                data = frames(at)
                out.append((qid, count, total, rate, at, [i / rate for i in at], hashlib.sha256(data.tobytes()).hexdigest()))
            yield pd.DataFrame(out, columns=["qid", "frames", "source_frames", "source_fps", "frame_indices", "timestamps_seconds", "raw_frames_sha256"])

    return clips.select("qid", "path").mapInPandas(sample, "qid string, frames int, source_frames int, source_fps double, frame_indices array<bigint>, timestamps_seconds array<double>, raw_frames_sha256 string")
