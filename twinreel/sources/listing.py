"""Files of a folder tree as rows."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import check_folders
from ..shipping import ship
from ..storage import materialize


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, mtime, size`` of every file; contents are not read."""
    path = F.regexp_replace("path", "^file:/*", "/")
    return _files(spark, folder).select(path.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"))


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content_hash``: what cannot be read raises and is not hashed as empty."""
    return _files(spark, folder).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("content_hash"))


def equal_contents(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Pairs (lo, hi) with ``equal``: whether their contents (path, content_hash)
    are the same; null where one is not known."""
    a, b = (hashes.select(F.col("path").alias(e), F.col("content_hash").alias(f"{e}_hash")) for e in ("lo", "hi"))
    both = pairs.join(a, "lo", "left").join(b, "hi", "left")
    return both.withColumn("equal", F.col("lo_hash") == F.col("hi_hash")).select("lo", "hi", "equal")


def pattern(glob: str) -> str:
    """A regular expression for a pattern of an ignore file: ``*`` and ``?`` stop at
    slashes, ``**`` does not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1 if glob[i + 1] == "!" else 0) + "]", end + 1
        else:
            i += glob[i] == "\\" and i + 1 < len(glob)
            out, i = out + re.escape(glob[i]), i + 1
    return out


def ignore_rules(text: str, folder: str) -> list[tuple[str, bool, bool]]:
    """(expression over the path, whether only folders count, whether it brings
    back) of each line of an ignore file in ``folder``."""
    out = []
    for raw in text.splitlines():
        line = raw.rstrip()
        back = line.startswith("!")
        line = line.removeprefix("!")
        if not line or line.startswith("#"):
            continue
        only_folders, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        body = pattern(line.lstrip("/"))
        out.append((re.escape(folder.rstrip("/")) + "/" + ("" if anchored else "(?:.*/)?") + body, only_folders, back))
    return out


def ignored(path: str, is_folder: bool, rules: list) -> bool:
    """What the last rule that fits says."""
    for expression, only_folders, back in reversed(rules):
        if (is_folder or not only_folders) and re.fullmatch(expression, path):
            return not back
    return False


def entries(folder: str, rules: list, exclude: list[str], extensions: list[str]) -> Iterator[tuple]:
    """(path, mtime, size, rules) of a folder's files and, with a null size, of the
    folders to enter."""
    held = list(os.scandir(folder))
    names = {e.name for e in held}
    tracked = bool(rules and rules[0][0] == "") or ".git" in names  # an empty first rule marks a repository
    rules = [("", False, True), *[r for r in rules if r[0]]] if tracked else rules
    for name in (".gitignore",) * tracked + (".ignore",):
        if name in names:
            with open(os.path.join(folder, name), errors="replace") as file:
                rules = rules + ignore_rules(file.read(), folder)
    for e in held:
        extension = os.path.splitext(e.name)[1][1:].lower()
        if e.name.startswith(".") or extension in extensions or e.path in exclude:
            continue
        is_folder = e.is_dir(follow_symlinks=False)
        if ignored(e.path, is_folder, rules):
            continue
        if is_folder:
            yield e.path, None, None, json.dumps(rules)
        elif e.is_file(follow_symlinks=False):
            stat = e.stat()
            yield e.path, int(stat.st_mtime), stat.st_size, None


def walk(spark: SparkSession, roots: Iterable[str], exclude: Iterable[str] = (), extensions: Iterable[str] = ()) -> DataFrame:
    """``path, mtime, size`` of the files that a walk from the roots comes by.

    Folders of a depth are listed in parallel, a round a depth, on a file system
    that all executors see.  A walk enters no hidden folder, no excluded one, none
    whose name has a barred extension, and none that an ignore file (``.ignore``,
    and ``.gitignore`` within a repository) names; files go by the same rules.  A
    root or an excluded folder that is not there is an error, and so is a root
    that is excluded.
    """
    roots, exclude, barred = list(roots), [e.rstrip("/") for e in exclude], [e.lower() for e in extensions]
    check_folders(roots, exclude)
    gone = [p for p in (*roots, *exclude) if not os.path.exists(p)]
    if gone:
        raise FileNotFoundError(f"no such folders: {gone}")
    ship(spark)
    schema = "path string, mtime bigint, size bigint, rules string"

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder, rules in zip(pdf["path"], pdf["rules"], strict=True):
                rows = list(entries(folder, [tuple(r) for r in json.loads(rules)], exclude, barred))
                yield pd.DataFrame(rows, columns=["path", "mtime", "size", "rules"]).astype({"mtime": "Int64", "size": "Int64"})

    single = [(p, int(os.stat(p).st_mtime), os.path.getsize(p), None) for p in roots if os.path.isfile(p)]
    found = spark.createDataFrame(single, schema)
    front = spark.createDataFrame([(p.rstrip("/") or "/", "[]") for p in roots if os.path.isdir(p)], "path string, rules string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while not front.isEmpty():
        level = materialize(front.select("path", "rules").repartition(parts, "path").mapInPandas(enter, schema), "walk")
        found = found.unionByName(level.where("size is not null"))
        front = level.where("size is null")
    return found.select("path", "mtime", "size").distinct()
