"""Sampling plans, probe output, resolution instructions and text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frames that a hash spreads over its duration, and the divisor of a frame rate.
SPREAD, RATE = 64, 16384
SKIP_FORWARD, HASH_DURATION = 15.0, 10.0


def sampling_plan(duration: Column, skip: float = SKIP_FORWARD, hashed: float = HASH_DURATION) -> Column:
    """(fps_num, fps_den, seek) for a duration in seconds; a rate without bound
    is the largest integer."""
    d = duration.cast("double")
    fps = F.when(d < 2, F.lit(float(SPREAD))).when(d == 2, F.lit(None).cast("double")).when(d < hashed, SPREAD / (d - 2)).otherwise(F.lit(SPREAD / hashed))
    seek = F.when(d < hashed, F.lit(0.0)).when(d < skip + hashed, d - hashed - 2).otherwise(F.lit(skip))
    number = F.coalesce(F.floor(fps * RATE), F.lit((1 << 31) - 1)).cast("bigint")
    return F.struct(F.least(number, F.lit((1 << 31) - 1)).alias("fps_num"), F.lit(RATE).alias("fps_den"), F.greatest(seek, F.lit(0.0)).alias("seek"))


PROBE = "format struct<duration:string,size:string>, streams array<struct<codec_type:string,width:bigint,height:bigint,side_data_list:array<struct<rotation:string>>>>"


def probe_info(probe: Column) -> Column:
    """(duration, size, width, height) of a probe's JSON: zero where it has no
    duration or size, and the first video stream's size, turned if it is."""
    j = F.from_json(probe, PROBE)
    video = F.get(F.filter(j["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    turn = rotation(F.coalesce(F.get(F.filter(video["side_data_list"]["rotation"], lambda r: r.isNotNull()), F.lit(0)), F.lit("0")))
    sideways = turn.isin(90, 270)
    return F.struct(
        F.coalesce(F.try_to_number(j["format"]["duration"], F.lit("999999999999D999999")).cast("double"), F.lit(0.0)).alias("duration"),
        F.coalesce(j["format"]["size"].try_cast("bigint"), F.lit(0).cast("bigint")).alias("size"),
        F.when(sideways, video["height"]).otherwise(video["width"]).alias("width"),
        F.when(sideways, video["width"]).otherwise(video["height"]).alias("height"),
    )


def is_video(codec_type: Column, duration: Column) -> Column:
    """A video stream of a second or more; an unknown duration counts as long."""
    return (codec_type == "video") & (F.coalesce(duration, F.lit(999.0)) >= 1.0)


def rotation(text: Column) -> Column:
    """0, 90, 180 or 270 for a rotation by quarters either way, else null."""
    degrees = F.trim(text).try_cast("double")
    return F.when(degrees.isin(0.0, 90.0, -90.0, 180.0, -180.0, 270.0, -270.0), F.pmod(degrees.cast("int"), F.lit(360)))


#: Instructions: pattern, then which groups are the name's, the folder's and the
#: contents' place (fixed values; white space may be left out).
GRAMMAR = (
    (r"^\s*(\d+)\s*as\s*(\d+)\s*at\s*(\d+)\s*$", 2, 3, 1),
    (r"^\s*(\d+)\s*at\s*(\d+)\s*as\s*(\d+)\s*$", 3, 2, 1),
    (r"^\s*(\d+)\s*at\s*(\d+)\s*$", 1, 2, 1),
    (r"^\s*(\d+)\s*as\s*(\d+)\s*$", 2, 2, 1),
    (r"^\s*(\d+)\s*$", 1, 1, 1),
)
UNTRASH = r"^\s*u(\d+)\s*$"


#: The places that an instruction names, in the order in which they are checked.
PLACES = ("basename_idx", "dirname_idx", "contents_idx")


def instruction(text: Column) -> Column:
    """(untrash, basename_idx, dirname_idx, contents_idx, too_large), or null if
    the text follows no form of the grammar.  ``too_large`` names the first place,
    of contents, name and folder, whose number no place can have; numbers are
    unsigned ones of 64 bits, of which those above the signed range are as good
    as too large, since no list is that long."""
    out = None
    for pattern, *groups, untrash in (*((*row, False) for row in GRAMMAR), (UNTRASH, 1, 1, 1, True)):
        digits = dict(zip(PLACES, (F.regexp_extract(text, pattern, g) for g in groups), strict=True))
        numbers = (d.try_cast("bigint").alias(n) for n, d in digits.items())
        order = ("contents_idx", "basename_idx", "dirname_idx")
        large = F.coalesce(*(F.when(digits[n].try_cast("bigint").isNull(), F.concat(F.lit(f"{n}: "), digits[n])) for n in order))
        made = F.struct(F.lit(untrash).alias("untrash"), *numbers, large.alias("too_large"))
        out = F.when(text.rlike(pattern), made) if out is None else out.when(text.rlike(pattern), made)
    return out


def instruction_errors(parsed: Column, entries: Column) -> Column:
    """What is wrong with an instruction's places, of so many entries; empty if
    nothing."""
    tests = (F.when(parsed[n] >= entries, F.concat(F.lit(f"{n.removesuffix('_idx')} index not valid: "), parsed[n].cast("string"), F.lit("."))) for n in PLACES)
    return F.coalesce(F.concat(F.lit("not a number: "), parsed["too_large"]), F.concat_ws(" ", *tests))


def byte_size(n: Column) -> Column:
    """Bytes with two decimals in units of 1024."""
    steps = ((1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB"))
    out = None
    for step, unit in steps:
        text = F.concat(F.format_string("%.2f", n / F.lit(float(step))), F.lit(f" {unit}"))
        out = F.when(n >= step, text) if out is None else out.when(n >= step, text)
    return out.otherwise(F.concat(n.cast("string"), F.lit(" B")))


def clock(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def dimensions(w: Column, h: Column) -> Column:
    return F.concat_ws("x", w.cast("string"), h.cast("string"))


def strip_comments(text: str) -> str:
    """A shell text without its comments.  ``#`` begins one outside quotes and
    escapes, at the start of a word; ``#!`` at the very start stays."""
    out, quote, i, fresh = [], "", 0, True
    if text.startswith("#!"):
        i = text.find("\n") if "\n" in text else len(text)
        out.append(text[:i])
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
            if c == "\\" and quote == '"':
                out.append(text[i : i + 2])
                i += 2
                continue
        elif c == "\\":
            out.append(text[i : i + 2])
            i, fresh = i + 2, False
            continue
        elif c in "'\"":
            quote = c
        elif c == "#" and fresh:
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
            continue
        out.append(c)
        fresh = not quote and c in " \t\r\n;&|()"
        i += 1
    return "".join(out)


#: Fields of a cache's metadata line, and the words that the first three may be
#: (fixed values).
METADATA = ("os", "backend", "crop", "skip_forward", "version")
WORDS = {"os": ("Windows", "Unix"), "backend": ("FfmpegBackend", "GstreamerBackend"), "crop": ("None", "Letterbox", "Motion")}


def parse_metadata(text: Column) -> Column:
    """The five fields of a cache's metadata line, in any case, with ``error``: the
    first field that is none of its words or no number; null if there are not
    five."""
    parts = F.split(text, ",")
    raw = {name: F.get(parts, F.lit(i)) for i, name in enumerate(METADATA)}
    fields = {n: F.lower(F.trim(raw[n])) for n in WORDS}
    fields |= {"skip_forward": raw["skip_forward"].try_cast("double"), "version": raw["version"].try_cast("bigint")}
    fine = {n: fields[n].isin([w.lower() for w in words]) for n, words in WORDS.items()} | {n: fields[n].isNotNull() for n in ("skip_forward", "version")}
    error = F.coalesce(*(F.when(~fine[n], F.concat(F.lit(f"{n}: "), raw[n])) for n in METADATA))
    made = F.struct(*(fields[n].alias(n) for n in METADATA), error.alias("error"))
    return F.when(F.size(parts) == 5, made)


def format_metadata(os: Column, backend: Column, cropping: Column, skip: Column, version: Column) -> Column:
    """A cache's metadata line, whole seconds without a point."""
    whole = F.when(skip == F.floor(skip), F.floor(skip).cast("bigint").cast("string")).otherwise(skip.cast("string"))
    return F.concat_ws(",", os, backend, cropping, whole, version.cast("string"))


def metadata_mismatch(parsed: Column, wanted: Column) -> Column:
    """The first field in which a cache's metadata differ from what is wanted;
    null if none does."""
    return F.coalesce(*(F.when(parsed[n] != wanted[n], F.concat(F.lit(f"{n} mismatch: Act: "), parsed[n].cast("string"), F.lit(", Exp: "), wanted[n].cast("string"))) for n in METADATA))


STREAMS = "format struct<duration:string>, streams array<struct<codec_type:string,width:bigint,height:bigint,avg_frame_rate:string>>"


def stream_info(probe: Column) -> Column:
    """(duration, width, height, frame_rate) over all video streams of a probe's
    JSON: the duration and the first stream's rate, and the size of the largest
    stream, the first of several; null without a video stream."""
    j = F.from_json(probe, STREAMS)
    videos = F.filter(j["streams"], lambda s: s["codec_type"] == "video")
    area = lambda s: F.coalesce(s["width"] * s["height"], F.lit(-1))
    largest = F.reduce(F.slice(videos, 2, F.greatest(F.size(videos), F.lit(1))), F.get(videos, F.lit(0)), lambda best, s: F.when(area(s) > area(best), s).otherwise(best))
    rate = F.split(F.get(videos, F.lit(0))["avg_frame_rate"], "/")
    number = lambda i: F.get(rate, F.lit(i)).try_cast("double")
    made = F.struct(
        j["format"]["duration"].try_cast("double").alias("duration"), largest["width"].alias("width"), largest["height"].alias("height"),
        F.try_divide(number(0), number(1)).alias("frame_rate"),
    )
    return F.when(F.size(videos) > 0, made)
