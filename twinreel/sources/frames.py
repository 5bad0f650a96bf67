"""Where frames and probe output come from."""

from __future__ import annotations

import json
import os
import select
import shutil
import subprocess
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

#: Bytes above which a frame is refused, and of an error message that are kept.
LARGEST_FRAME, MESSAGE = 5_000_000_000, 500


class FrameSource(Protocol):
    """A backend.  Its methods run on the executors, so it is pickled; ``payload``
    is what a row carries beside its path, such as a file's content, or None."""

    def probe(self, path: str, payload: bytes | None = None) -> str:
        """What ffprobe says of a file, as JSON."""

    def frames(self, path: str, fps: float, start: float, count: int, width: int = 0, height: int = 0, payload: bytes | None = None) -> Iterator[np.ndarray | None]:
        """At most ``count`` gray frames from ``start`` seconds on; None stands for
        one that cannot be read."""


def described(duration: float, size: int, width: int, height: int) -> str:
    """Probe output of a video with one stream."""
    return json.dumps({"format": {"duration": f"{duration:.2f}", "size": str(size)}, "streams": [{"codec_type": "video", "width": width, "height": height}]})


@dataclass
class MemoryFrames:
    """Frames at hand, by path, at ``rate`` a second."""

    videos: dict[str, list[np.ndarray | None]]
    rate: float = 1.0

    def probe(self, path: str, payload: bytes | None = None) -> str:
        frames = self.videos[path]
        h, w = next((f.shape for f in frames if f is not None), (0, 0))
        return described(len(frames) / self.rate, len(frames) * w * h, w, h)

    def frames(self, path: str, fps: float, start: float, count: int, width: int = 0, height: int = 0, payload: bytes | None = None) -> Iterator[np.ndarray | None]:
        first = int(start * fps)
        yield from self.videos[path][first : first + count]


@dataclass
class BytesFrames:
    """Content as raw gray frames of ``side`` by ``side`` bytes, which begin again
    after the last whole one; a hundred bytes last a second."""

    side: int = 16

    def probe(self, path: str, payload: bytes | None = None) -> str:
        size = len(payload or b"")
        return described(size / 100, size, self.side, self.side)

    def frames(self, path: str, fps: float, start: float, count: int, width: int = 0, height: int = 0, payload: bytes | None = None) -> Iterator[np.ndarray | None]:
        size = self.side * self.side
        whole = np.frombuffer(payload or b"", np.uint8)
        whole = whole[: len(whole) // size * size].reshape(-1, self.side, self.side)
        for i in range(count if len(whole) else 0):
            yield whole[(int(start * fps) + i) % len(whole)]


def run(command: list[str], timeout: float) -> str:
    """Standard output of a command; what it says of an error, cut, if it fails."""
    done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr[:MESSAGE])
    return done.stdout


@dataclass
class FfmpegFrames:
    """Frames of one ffmpeg process a video, read as they come and ended with
    the iteration; whole seconds of the start count.

    ``rate`` overrides the frame rate, ``spread`` makes it so that the frames are
    spread over the video's duration, ``skip`` leaves out frames at the start,
    ``threads`` are those of the decoder, and no frame may take longer than
    ``timeout`` seconds.
    """

    rate: float | None = None
    spread: bool = False
    skip: int = 0
    threads: int = 1
    timeout: float = 60.0

    @staticmethod
    def available() -> bool:
        return all(map(shutil.which, ("ffmpeg", "ffprobe")))

    def probe(self, path: str, payload: bytes | None = None) -> str:
        return run(["ffprobe", "-v", "quiet", "-show_format", "-show_streams", "-of", "json", path], self.timeout)

    def command(self, path: str, fps: float, start: float, count: int) -> list[str]:
        seek = ["-ss", str(int(start))] if int(start) > 0 else []
        return [
            "ffmpeg", "-hide_banner", "-loglevel", "error", "-nostdin", "-threads", str(self.threads), *seek, "-i", path, "-vf", f"fps={fps}",
            "-frames:v", str(count + self.skip), "-pix_fmt", "gray", "-f", "rawvideo", "-",
        ]

    def fps(self, path: str, fps: float, count: int) -> float:
        if self.spread:
            duration = float(json.loads(self.probe(path))["format"].get("duration", 0) or 0)
            return (count + self.skip) / duration if duration > 0 else fps
        return self.rate or fps

    def frames(self, path: str, fps: float, start: float, count: int, width: int = 0, height: int = 0, payload: bytes | None = None) -> Iterator[np.ndarray | None]:
        size = width * height
        if not 0 < size <= LARGEST_FRAME:
            raise ValueError(f"a frame of {size} bytes")
        process = subprocess.Popen(self.command(path, self.fps(path, fps, count), start, count), stdout=subprocess.PIPE, stderr=subprocess.PIPE)
        got = 0
        try:
            for i in range(count + self.skip):
                data = self.read(process, size)
                if len(data) < size:
                    break
                got += 1
                if i >= self.skip:
                    yield np.frombuffer(data, np.uint8).reshape(height, width)
            if not got and (said := process.communicate(timeout=self.timeout)[1]):
                raise RuntimeError(said.decode(errors="replace")[:MESSAGE])
        finally:
            process.kill()
            process.wait(self.timeout)

    def read(self, process: subprocess.Popen, size: int) -> bytes:
        """A frame, or less at the end of the stream."""
        out, until, pipe = bytearray(), time.monotonic() + self.timeout, process.stdout.fileno()
        while len(out) < size:
            if not select.select([pipe], [], [], max(0.0, until - time.monotonic()))[0]:
                raise TimeoutError(f"no frame in {self.timeout} seconds")
            part = os.read(pipe, min(size - len(out), 1 << 20))
            if not part:
                break
            out += part
        return bytes(out)


def probe_paths(files: DataFrame, source: FrameSource) -> DataFrame:
    """``path, probe, err_msg`` of files (path, and ``payload`` if there is one):
    what the source says of each, or why it does not."""
    ship(files.sparkSession)
    columns = ["path", "payload"] if "payload" in files.columns else ["path"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, *payload in pdf.itertuples(index=False):
                try:
                    rows.append((path, source.probe(path, *payload), None))
                except Exception as error:  # whatever a backend says of a file is that file's result
                    rows.append((path, None, f"{type(error).__name__}: {error}"[:MESSAGE]))
            yield pd.DataFrame(rows, columns=["path", "probe", "err_msg"])

    return files.select(columns).mapInPandas(run, "path string, probe string, err_msg string")
