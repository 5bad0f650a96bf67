"""Path predicates and edits, as columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def under(path: Column, folders: Iterable[str]) -> Column:
    """Whether the path is one of the folders or lies below one, by components."""
    tests = [(path == f) | path.startswith(f.rstrip("/") + "/") for f in folders]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def extension(path: Column) -> Column:
    """Lower-case extension of the last component; empty for none, and for names
    that only begin with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def includes(path: Column, include: Iterable[str], exclude: Iterable[str] = (), extensions: Iterable[str] = ()) -> Column:
    """Below an included folder, below no excluded one, no excluded extension."""
    barred = [e.lower() for e in extensions]
    return under(path, include) & ~under(path, exclude) & (~extension(path).isin(barred) if barred else F.lit(True))


def check_folders(include: Iterable[str], exclude: Iterable[str]) -> None:
    """An included folder that is itself excluded is an error."""
    exclude = list(exclude)
    for path in include:
        for out in exclude:
            if path == out or path.startswith(out.rstrip("/") + "/"):
                raise ValueError(f"{path} is included but lies in the excluded {out}")


def roles(path: Column, candidates: list[str], references: list[str], exclude: Iterable[str] = (), extensions: Iterable[str] = ()) -> tuple[Column, Column, Column]:
    """(all, candidate, reference): folders of one role are excluded from the other."""
    both = set(candidates) & set(references)
    if both:
        raise ValueError(f"folders in both roles: {sorted(both)}")
    exclude = list(exclude)
    check_folders([*candidates, *references], exclude)
    check_folders(references, candidates)
    return (
        includes(path, [*candidates, *references], exclude, extensions),
        includes(path, candidates, [*exclude, *references], extensions),
        includes(path, references, [*exclude, *candidates], extensions) if references else F.lit(False),
    )


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def with_basename(path: Column, name: Column) -> Column:
    """The path with another's file name."""
    return F.concat(dirname(path), F.lit("/"), name)


def with_extension(path: Column, other: Column) -> Column:
    """The path with another's extension, or without one if that has none."""
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    given = F.regexp_extract(other, r"[^/](\.[^./]*)$", 1)
    return F.concat(stem, given)


def trash_path(path: Column, trash: str) -> Column:
    return F.concat(F.lit(trash.rstrip("/") + "/"), F.regexp_replace(path, "^/+", ""))


def untrash_path(path: Column, trash: str) -> Column:
    return F.substring(path, F.lit(len(trash.rstrip("/")) + 1), F.length(path))


def walked(path: Column, roots: Iterable[str], exclude: Iterable[str] = (), extensions: Iterable[str] = ()) -> Column:
    """Whether a walk from the roots comes by a file: it enters no hidden folder,
    none whose name has a barred extension, and no excluded one."""
    barred = [e.lower() for e in extensions]

    def below(root: str) -> Column:
        rest = F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))
        parts = F.split(rest, "/")
        open_ = ~F.exists(parts, lambda p: p.startswith("."))
        if barred:
            open_ &= ~F.exists(parts, lambda p: extension(p).isin(barred))
        return under(path, [root]) & open_

    return reduce(lambda a, b: a | b, map(below, roots), F.lit(False)) & ~under(path, exclude)
