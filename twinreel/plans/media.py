"""Queries that take texts for videos, and their DuckDB SQL.

A text's bytes are gray frames, so that every media operator runs over a whole
table without a decoder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import bit_list
from ..media import hashing
from ..media.transform import resize
from ..sources.adapters import embedding_items, table
from ..sources.frames import BytesFrames


def _videos(spark: SparkSession, sf_dir: str, side: int = 8) -> DataFrame:
    return hashing.text_frames(table(spark, sf_dir, "documents"), side=side)


def letterbox(spark, sf_dir):
    """The bars that frames 0 and 8 of each text have in common."""
    return hashing.detect_crops(_videos(spark, sf_dir), "letterbox")


def motion_crop(spark, sf_dir):
    return hashing.detect_crops(_videos(spark, sf_dir), "motion")


def frame_change(spark, sf_dir):
    return hashing.change_stats(_videos(spark, sf_dir))


def frame_resize(spark, sf_dir):
    """The first frame of each text at half its size, pixel by pixel."""
    small = hashing.per_video(_videos(spark, sf_dir), lambda frames: (resize(frames[0], 4, 4).ravel().astype(np.int64).tolist(),), "pixels array<bigint>")
    return small.select("path", F.posexplode("pixels").alias("place", "value"))


def _words(hashed: DataFrame) -> DataFrame:
    return hashed.select("path", F.posexplode("hash").alias("place", "word"))


def dct_hash(spark, sf_dir):
    """Hashes of sixteen frames of 16 by 16 bytes, word by word."""
    return _words(hashing.hash_videos(_videos(spark, sf_dir, 16), hashing.CreationOptions(cropdetect="none")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/doc/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))


def path_hash(spark, sf_dir):
    """From a path to its hash: probe, sampling plan, frames, transform."""
    return _words(hashing.hash_paths(_files(spark, sf_dir), BytesFrames(), hashing.CreationOptions(cropdetect="none")))


def path_errors(spark, sf_dir):
    """Why a path has no hash."""
    return hashing.hash_paths(_files(spark, sf_dir), BytesFrames()).where("err_kind is not null").select("path", "err_kind")


def path_hash_cropped(spark, sf_dir):
    """As ``path_hash``, with the letterbox cut off."""
    return _words(hashing.hash_paths(_files(spark, sf_dir), BytesFrames()))


def hash_bits(spark, sf_dir):
    """How many of a hash's bits are set, and the lowest and highest of them."""
    bits = embedding_items(spark, sf_dir).select("id", F.posexplode(bit_list(F.array("w0"), 64)).alias("bit", "value")).where("value = 1")
    return bits.groupBy("id").agg(F.count("*").alias("n"), F.min("bit").alias("lowest"), F.max("bit").alias("highest"))


_BYTES = "data AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents)"


def _pixels(side: int) -> str:
    size = side * side
    return f"""{_BYTES},
px AS (
  SELECT doc_id, f, y, x, CAST('0x' || substr(h, 2 * (f * {size} + y * {side} + x) + 1, 2) AS INT) AS v
  FROM data, range(16) a(f), range({side}) b(y), range({side}) c(x) WHERE (f + 1) * {size} <= n)"""


_LETTERBOX = f"""WITH {_pixels(8)},
strips AS (SELECT doc_id, f, 'c' AS axis, x AS i, v FROM px WHERE f IN (0, 8) UNION ALL SELECT doc_id, f, 'r', y, v FROM px WHERE f IN (0, 8)),
counts AS (SELECT doc_id, f, axis, i, v, count(*) AS c FROM strips GROUP BY ALL),
modes AS (SELECT doc_id, f, axis, i, v AS mode FROM counts QUALIFY row_number() OVER (PARTITION BY doc_id, f, axis, i ORDER BY c DESC, v DESC) = 1),
bars AS (SELECT doc_id, f, axis, i, count(*) FILTER (WHERE abs(v - mode) <= 16) > 0.9 * 8 AS bar FROM strips JOIN modes USING (doc_id, f, axis, i) GROUP BY ALL),
sides AS (
  SELECT doc_id, f, coalesce(min(i) FILTER (WHERE axis = 'c' AND NOT bar), 8) AS l, 7 - coalesce(max(i) FILTER (WHERE axis = 'c' AND NOT bar), -1) AS r,
    coalesce(min(i) FILTER (WHERE axis = 'r' AND NOT bar), 8) AS t, 7 - coalesce(max(i) FILTER (WHERE axis = 'r' AND NOT bar), -1) AS b
  FROM bars GROUP BY 1, 2),
fair AS (SELECT doc_id, CASE WHEN l + r < 8 AND t + b < 8 THEN [l, r, t, b] ELSE [0, 0, 0, 0] END AS s FROM sides)
SELECT '/doc/' || doc_id AS path, CAST(min(s[1]) AS INT) AS "left", CAST(min(s[2]) AS INT) AS "right", CAST(min(s[3]) AS INT) AS top, CAST(min(s[4]) AS INT) AS bottom
FROM fair GROUP BY doc_id"""

_CHANGE = f"""WITH {_pixels(8)},
steps AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY doc_id, y, x ORDER BY f)) AS d FROM px),
pixel AS (SELECT doc_id, y, x, min(v) AS low, least(65535, sum(CASE WHEN d >= 8 THEN d ELSE 0 END)) AS change FROM steps GROUP BY ALL),
modal AS (SELECT doc_id, v FROM (SELECT doc_id, v, count(*) AS c FROM px GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, v DESC) = 1),
ends AS (SELECT doc_id, min(v) AS low, max(v) AS high FROM px GROUP BY 1)
SELECT '/doc/' || p.doc_id AS path, count(*) FILTER (WHERE p.low < 210) AS dark, CAST(sum(change) AS BIGINT) AS change, CAST(max(change) AS BIGINT) AS largest,
  any_value(e.low) AS low, any_value(e.high) AS high, any_value(m.v) AS modal
FROM pixel p JOIN ends e USING (doc_id) JOIN modal m USING (doc_id) GROUP BY p.doc_id"""

_RESIZE = f"""WITH {_pixels(8)},
raw AS (
  SELECT o, i, CASE WHEN abs(d) >= 3 THEN 0 WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) END AS w
  FROM (SELECT o, i, (i + 0.5 - (o + 0.5) * 2) / 2.0::DOUBLE AS d FROM range(4) a(o), range(8) b(i))),
weights AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM raw),
tall AS (SELECT doc_id, wy.o AS y, x, sum(wy.w * v) AS v FROM px JOIN weights wy ON wy.i = px.y WHERE f = 0 GROUP BY ALL),
small AS (SELECT doc_id, y, wx.o AS x, sum(wx.w * v) AS v FROM tall JOIN weights wx ON wx.i = tall.x GROUP BY ALL)
SELECT '/doc/' || doc_id AS path, CAST(y * 4 + x AS INT) AS place, CAST(greatest(0, least(255, round_even(v, 0))) AS BIGINT) AS value FROM small"""


def _hashes(cube: str) -> str:
    """Words of the transform of ``cube`` (doc_id, t, y, x, v)."""
    basis = "cos(pi() * {k} * (2 * {x} + 1) / 32)"
    return f"""{cube},
a AS (SELECT doc_id, k AS kt, y, x, sum(v * {basis.format(k="k", x="t")}) AS v FROM cube, range(10) r(k) GROUP BY ALL),
b AS (SELECT doc_id, kt, k AS kx, y, sum(v * {basis.format(k="k", x="x")}) AS v FROM a, range(10) r(k) GROUP BY ALL),
c AS (SELECT doc_id, kt * 100 + kx * 10 + k AS i, sum(v * {basis.format(k="k", x="y")}) AS v FROM b, range(10) r(k) GROUP BY ALL),
w AS (SELECT doc_id, i // 64 AS place, sum(CASE WHEN v > 1e-6 THEN CAST(1 AS HUGEINT) << CAST(i % 64 AS INT) ELSE 0 END) AS word FROM c GROUP BY ALL)
SELECT '/doc/' || doc_id AS path, CAST(place AS INT) AS place,
  CAST(CASE WHEN word >= 9223372036854775808 THEN word - 18446744073709551616 ELSE word END AS BIGINT) AS word FROM w"""


_DCT_HASH = _hashes(
    f"WITH {_pixels(16)}, cube AS (SELECT doc_id, f AS t, y, x, v - 128 AS v FROM px WHERE doc_id IN (SELECT doc_id FROM data WHERE n >= 4096))"
)
#: Seconds are hundredths of the bytes; the first frame is the start times the rate.
_PLANNED = f"""WITH {_BYTES},
timed AS (SELECT *, n // 256 AS whole, CASE WHEN n = 0 THEN 999 ELSE CAST(n AS DOUBLE) / 100 END AS long, CAST(n AS DOUBLE) / 100 AS s FROM data),
planned AS (
  SELECT *, CASE WHEN s = 2 THEN 2147483647 ELSE least(2147483647, floor(CASE WHEN s < 2 THEN 64 WHEN s < 10 THEN 64 / (s - 2) ELSE 6.4::DOUBLE END * 16384)) END / 16384::DOUBLE AS fps,
    CASE WHEN s < 10 THEN 0 WHEN s < 25 THEN greatest(0, s - 12) ELSE 15 END AS seek FROM timed)"""
_PATH_HASH = _hashes(
    f"""{_PLANNED},
cube AS (
  SELECT doc_id, t, y, x, CAST('0x' || substr(h, 2 * (((CAST(trunc(seek * fps) AS BIGINT) + t) % whole) * 256 + y * 16 + x) + 1, 2) AS INT) - 128 AS v
  FROM (SELECT * FROM planned WHERE long >= 1 AND whole > 0), range(16) a(t), range(16) b(y), range(16) c(x))"""
)

ALL = (letterbox, motion_crop, frame_change, frame_resize, dct_hash, path_hash, path_errors, path_hash_cropped, hash_bits)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "letterbox": _LETTERBOX,
        "frame_change": _CHANGE,
        "frame_resize": _RESIZE,
        "dct_hash": _DCT_HASH,
        "path_hash": _PATH_HASH,
        "path_errors": f"{_PLANNED} SELECT '/doc/' || doc_id AS path, CASE WHEN long < 1 THEN 'NotVideo' ELSE 'NotEnoughFrames' END AS err_kind FROM planned WHERE long < 1 OR whole = 0",
        "hash_bits": """SELECT vec_id AS id, count(*) AS n, CAST(min(i) AS INT) AS lowest, CAST(max(i) AS INT) AS highest
FROM embeddings, range(64) r(i) WHERE embedding[i + 1] > 0 GROUP BY vec_id""",
    }
