"""Hashes of videos as a Spark operator over their frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.hashing import DCT_SIDE
from ..shipping import ship
from ..sources.frames import MESSAGE, FrameSource, probe_paths
from .crop import darkest, frame_change, hash_letterbox, motion_crop
from .transform import hash_frames


#: What detects a crop, by its name.
CROPS: dict[str, Callable] = {"none": lambda frames: None, "letterbox": hash_letterbox, "motion": motion_crop}


@dataclass(frozen=True)
class CreationOptions:
    skip_forward: float = 15.0
    duration: float = 10.0
    cropdetect: str = "letterbox"  # or "none" or "motion"

    def __post_init__(self):
        if self.cropdetect not in CROPS:
            raise ValueError(self.cropdetect)


def hash_video(frames: list[np.ndarray | None], options: CreationOptions) -> tuple[list[int] | None, str | None, str | None]:
    """(words, error kind, message) of a video's gray frames; None stands for one
    that cannot be read, which is an error of the first frame only."""
    if frames and frames[0] is None:
        return None, "VidProc", "the first frame cannot be read"
    frames = [f for f in frames if f is not None][:DCT_SIDE]
    if len(frames) < DCT_SIDE:
        return None, "NotEnoughFrames", f"{len(frames)} frames"
    if len({f.shape for f in frames}) > 1:
        return None, "VidProc", "frames differ in size"
    crop = CROPS[options.cropdetect](frames)
    return hash_frames([crop.apply(f) for f in frames] if crop else frames), None, None


def hash_videos(videos: DataFrame, options: CreationOptions = CreationOptions()) -> DataFrame:  # noqa: B008
    """``path, hash, err_kind, err_msg`` from (path, w, h, frames: array of gray
    frames as bytes).  Frames of a wrong length cannot be read; a video is one row,
    of sixteen frames, so a task holds a few of them at a time."""
    ship(videos.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, w, h, frames in zip(pdf["path"], pdf["w"], pdf["h"], pdf["frames"], strict=True):
                if frames is None or not w or not h:
                    rows.append((path, None, "NotVideo", "no frames"))
                    continue
                whole = [np.frombuffer(f, np.uint8).reshape(int(h), int(w)) if f is not None and len(f) == w * h else None for f in frames]
                rows.append((path, *hash_video(whole, options)))
            yield pd.DataFrame(rows, columns=["path", "hash", "err_kind", "err_msg"])

    return videos.select("path", "w", "h", "frames").mapInPandas(run, "path string, hash array<bigint>, err_kind string, err_msg string")


def text_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = 8, count: int = DCT_SIDE) -> DataFrame:
    """Texts as videos for tests: their first bytes as gray frames; shorter ones
    have fewer frames."""
    data, size = F.coalesce(F.col(text_col), F.lit("")).cast("binary"), side * side
    pieces = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring(data, i * size + 1, F.lit(size)))
    whole = F.filter(pieces, lambda p: F.octet_length(p) == size)
    return docs.select(F.concat(F.lit("/doc/"), F.col(id_col).cast("string")).alias("path"), F.lit(side).alias("w"), F.lit(side).alias("h"), whole.alias("frames"))


def hash_paths(files: DataFrame, source: FrameSource, options: CreationOptions = CreationOptions()) -> DataFrame:  # noqa: B008
    """``path, duration, hash, err_kind, err_msg`` of files (path, and ``payload``
    if a row carries one): probe, sampling plan, frames, crop, hash.

    Files that cannot be probed, or have no video of a second or more, are
    errors, as are those whose frames fail; each file is one row of a task.
    """
    probed = probe_paths(files, source)
    info = probed.select("path", "probe", "err_msg", parsing.probe_info(F.col("probe")).alias("p"))
    plan = parsing.sampling_plan(F.col("p.duration"), options.skip_forward, options.duration)
    planned = info.select(
        "path", "err_msg", F.col("p.duration").alias("duration"), F.col("p.width").alias("width"), F.col("p.height").alias("height"), plan.alias("plan"),
        parsing.is_video(F.when(F.col("p.width").isNotNull(), F.lit("video")), F.nullif(F.col("p.duration"), F.lit(0.0))).alias("video"),
    )
    planned = planned.select("path", "err_msg", "duration", "width", "height", "video", (F.col("plan.fps_num") / F.col("plan.fps_den")).alias("fps"), F.col("plan.seek").alias("seek"))
    if "payload" in files.columns:
        planned = planned.join(files.select("path", "payload"), "path")
    carried = "payload" in files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.err_msg is not None:
                    rows.append((r.path, None, None, "VidProc", r.err_msg))
                elif not r.video:
                    rows.append((r.path, r.duration, None, "NotVideo", "no video of a second or more"))
                else:
                    try:
                        frames = list(source.frames(r.path, r.fps, r.seek, DCT_SIDE, int(r.width), int(r.height), r.payload if carried else None))
                        rows.append((r.path, r.duration, *hash_video(frames, options)))
                    except Exception as error:  # whatever a backend says of a file is that file's result
                        rows.append((r.path, r.duration, None, "VidProc", f"{type(error).__name__}: {error}"[:MESSAGE]))
            yield pd.DataFrame(rows, columns=["path", "duration", "hash", "err_kind", "err_msg"])

    return planned.mapInPandas(run, "path string, duration double, hash array<bigint>, err_kind string, err_msg string")


def per_video(videos: DataFrame, measure: Callable[[list[np.ndarray]], tuple], schema: str) -> DataFrame:
    """``path`` and what ``measure`` says of each video's frames; videos (path, w,
    h, frames) without a readable frame have no row."""
    ship(videos.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, w, h, frames in zip(pdf["path"], pdf["w"], pdf["h"], pdf["frames"], strict=True):
                whole = [np.frombuffer(f, np.uint8).reshape(int(h), int(w)) for f in (frames if frames is not None else ()) if f is not None and len(f) == w * h]
                if whole:
                    rows.append((path, *measure(whole)))
            yield pd.DataFrame(rows, columns=["path", *names])

    return videos.select("path", "w", "h", "frames").mapInPandas(run, f"path string, {schema}")


def detect_crops(videos: DataFrame, cropdetect: str = "letterbox") -> DataFrame:
    """``path, left, right, top, bottom`` of what each video is cropped by, all
    zero where nothing is."""

    def measure(frames: list[np.ndarray]) -> tuple:
        crop = CROPS[cropdetect](frames)
        return (crop.left, crop.right, crop.top, crop.bottom) if crop else (0, 0, 0, 0)

    return per_video(videos, measure, "left int, right int, top int, bottom int")


def change_stats(videos: DataFrame) -> DataFrame:
    """``path, dark, change, largest, low, high, modal``: dark pixels of the
    darkest frame, the sum and largest value of the frames' changes, and of all
    pixels the least, the greatest and the most frequent, the greatest of several."""

    def measure(frames: list[np.ndarray]) -> tuple:
        change, counts = frame_change(frames), np.bincount(np.concatenate([f.ravel() for f in frames]), minlength=256)
        low, high, modal = min(int(f.min()) for f in frames), max(int(f.max()) for f in frames), 255 - int(np.argmax(counts[::-1]))
        return int((darkest(frames) > 0).sum()), int(change.sum()), int(change.max()), low, high, modal

    return per_video(videos, measure, "dark bigint, change bigint, largest bigint, low int, high int, modal int")
