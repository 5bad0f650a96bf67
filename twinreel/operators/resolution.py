"""Resolution plans: what would be done with the files of a group.

A plan is a table; executors never touch a file.  ``execute`` carries a plan out
on the driver's machine, for who asks for it.
"""

from __future__ import annotations

import errno
import os
import shutil
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing, paths


def review_order(groups: DataFrame) -> DataFrame:
    """Members with ``entry_idx``: references first, then by bytes of the path;
    what is equal in both keeps its ``place``, or, without one, goes by its path."""
    ties = ["place"] if "place" in groups.columns else []
    order = Window.partitionBy("group_id").orderBy(F.desc("is_reference"), F.octet_length("path"), *ties, "path")
    return groups.withColumn("entry_idx", F.row_number().over(order) - 1)


def duplicated_entries(groups: DataFrame) -> DataFrame:
    """``group_id, path`` of the paths that a group lists several times."""
    return groups.groupBy("group_id", "path").agg(F.count("*").alias("n")).where("n > 1").select("group_id", "path")


def winning(groups: DataFrame) -> DataFrame:
    """Members with what speaks for keeping each: so far, being a reference."""
    return groups.select("group_id", "path", F.col("is_reference").alias("wins_reference"), F.lit(False).alias("wins_size"), F.lit(False).alias("wins_resolution"))


def plan(groups: DataFrame, instructions: DataFrame, trash: str = "/trash", files: DataFrame | None = None) -> DataFrame:
    """``group_id, action, src, dst, error`` for instructions (group_id, text) on
    groups in review order.

    What an instruction keeps are the contents of one entry, under the name of
    one and in the folder of one; the other entries go to the trash.  An entry
    that lies in the trash can be brought back to where it was, and not be
    trashed again.  A group that lists a path twice, and an instruction that is
    none or is out of range, give one row with the error.

    With ``files`` (path, content_hash), what exists counts too: contents that are
    missing and a target that exists and is not trashed are errors, an entry whose
    equal is in the trash already is deleted, and whatever moves onto a path that
    exists gets the next free name.
    """
    entries = groups.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry_idx", "path"))), lambda e: e["path"]).alias("paths"))
    rows = instructions.join(entries, "group_id").withColumn("i", parsing.instruction(F.col("text")))
    at = lambda field: F.get(F.col("paths"), F.col(f"i.{field}").cast("int"))
    in_trash = lambda p: paths.under(p, [trash.rstrip("/")])
    n, contents = F.size("paths"), at("contents_idx")
    twice, back = F.size(F.array_distinct("paths")) < n, F.col("i.untrash")
    trashed = F.exists("paths", lambda p: (p != contents) & in_trash(p))
    error = (
        F.when(F.col("i").isNull(), F.concat(F.lit("not understood: "), "text"))
        .when(parsing.instruction_errors(F.col("i"), n) != "", parsing.instruction_errors(F.col("i"), n))
        .when(back & ~in_trash(contents), F.concat(F.lit("not in the trash: "), contents))
        .when(~back & twice, F.lit("a file is listed twice"))
        .when(~back & trashed, F.lit("already in the trash"))
    )
    # the name is another entry's, the extension stays that of the contents
    name = paths.with_extension(paths.with_basename(at("dirname_idx"), paths.basename(at("basename_idx"))), contents)
    stays = (F.col("i.contents_idx") == F.col("i.basename_idx")) & (F.col("i.contents_idx") == F.col("i.dirname_idx"))
    target = F.when(back, paths.untrash_path(contents, trash)).when(~stays, name)
    rows = rows.select("group_id", "paths", back.alias("back"), contents.alias("keep"), target.alias("target"), error.alias("error"))
    if files is not None:
        rows = _against_files(rows, files)
    bad = rows.where("error is not null").select("group_id", F.lit("error").alias("action"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), "error")
    good = rows.where("error is null")
    moved = good.where("target is not null").select("group_id", F.when(F.col("back"), "untrash").otherwise("move").alias("action"), F.col("keep").alias("src"), F.col("target").alias("dst"), "error")
    gone = good.where("not back").select("group_id", "keep", "error", F.explode("paths").alias("src")).where("src <> keep")
    gone = gone.select("group_id", F.lit("trash").alias("action"), "src", paths.trash_path(F.col("src"), trash).alias("dst"), "error")
    if files is not None:
        gone = _delete_equals(gone, files)
        renamed = free_names(gone.where("action = 'trash'").unionByName(moved.where("action = 'move'")), files.join(gone.select(F.col("src").alias("path")), "path", "left_anti"))
        gone, moved = renamed.unionByName(gone.where("action = 'delete'")), moved.where("action = 'untrash'")
    return bad.unionByName(gone).unionByName(moved)


def _against_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    there = files.select("path").distinct()
    rows = rows.join(there.select(F.col("path").alias("keep"), F.lit(True).alias("kept")), "keep", "left")
    rows = rows.join(there.select(F.col("path").alias("target"), F.lit(True).alias("taken")), "target", "left")
    freed = ~F.col("back") & F.array_contains("paths", F.col("target")) & (F.col("target") != F.col("keep"))
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("taken") & ~freed, F.concat(F.lit("exists: "), "target"))
        .when(F.col("kept").isNull(), F.concat(F.lit("missing: "), "keep"))
    )
    return rows.withColumn("error", error).drop("kept", "taken")


def _delete_equals(gone: DataFrame, files: DataFrame) -> DataFrame:
    """Of what goes to the trash, files whose equal lies there are deleted."""
    mine = files.select(F.col("path").alias("src"), F.col("content_hash").alias("own"))
    trashed = files.select(F.col("path").alias("dst"), F.col("content_hash").alias("other"))
    judged = gone.join(mine, "src", "left").join(trashed, "dst", "left")
    equal = F.coalesce(F.col("own") == F.col("other"), F.lit(False))
    return judged.select("group_id", F.when(equal, "delete").otherwise("trash").alias("action"), "src", F.when(~equal, F.col("dst")).alias("dst"), "error")


#: A number in brackets before the extension, as free names get one.
NUMBERED = r"^(.*[^/]) \(([1-9][0-9]*)\)(\.[^./]*)?$"


def numbered(path: Column, k: Column) -> Column:
    """``path`` with " (k)" before its extension."""
    extension = F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(extension))
    return F.concat(stem, F.lit(" ("), k.cast("string"), F.lit(")"), extension)


def free_names(moves: DataFrame, existing: DataFrame) -> DataFrame:
    """Moves (with ``dst``) whose destination is none of the ``existing`` paths:
    the first free number goes before the extension of what is taken."""
    listed = existing.select("path").distinct()
    taken = listed.where(F.col("path").rlike(NUMBERED)).select(
        F.concat(F.regexp_extract("path", NUMBERED, 1), F.regexp_extract("path", NUMBERED, 3)).alias("dst"), F.regexp_extract("path", NUMBERED, 2).cast("bigint").alias("k")
    )
    numbers = taken.groupBy("dst").agg(F.collect_set("k").alias("ks"))
    rows = moves.join(listed.select(F.col("path").alias("dst"), F.lit(True).alias("there")), "dst", "left").join(numbers, "dst", "left")
    ks = F.coalesce("ks", F.array().cast("array<bigint>"))
    first = F.array_min(F.array_except(F.sequence(F.lit(1).cast("bigint"), F.size(ks) + F.lit(1).cast("bigint")), ks))
    free = F.when(F.col("there"), numbered(F.col("dst"), first)).otherwise(F.col("dst"))
    return rows.withColumn("dst", free).select(moves.columns)


def free_name(path: str) -> str:
    """``path``, or the first numbered name beside it that does not exist."""
    stem, extension = os.path.splitext(path)
    out, k = path, 0
    while os.path.lexists(out):
        k += 1
        out = f"{stem} ({k}){extension}"
    return out


def move_file(src: str, dst: str) -> str:
    """Move a file to ``dst`` or a free name beside it, which is returned; across
    devices, or where a rename is not permitted, it is copied and then deleted."""
    if not os.path.exists(src):
        raise FileNotFoundError(src)
    dst = free_name(dst)
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    try:
        os.rename(src, dst)
    except OSError as error:
        if error.errno not in (errno.EPERM, errno.EXDEV):
            raise
        shutil.copyfile(src, dst)
        os.remove(src)
    return dst


def execute(actions: Iterable[tuple[str, str, str | None]]) -> list[tuple[str, str, str | None]]:
    """Carry out (action, src, dst) rows of a plan on this machine, deletions and
    trash before moves; what was done is returned with the names that were used."""
    rank = {"delete": 0, "trash": 1, "untrash": 2, "move": 2}
    done = []
    for action, src, dst in sorted((a for a in actions if a[0] in rank), key=lambda a: rank[a[0]]):
        if action == "delete":
            os.remove(src)
        done.append((action, src, None if action == "delete" else move_file(src, dst)))
    return done
