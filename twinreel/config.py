"""What a run is asked to do: options, their defaults and conflicts."""

from __future__ import annotations

import argparse
import os
import shlex
from collections.abc import Sequence
from dataclasses import dataclass, field

from .functions.hashing import CLI_TOLERANCE
from .functions.parsing import HASH_DURATION, SKIP_FORWARD, strip_comments

#: Extensions that are left out unless others are given (fixed values).
EXCLUDED = (
    "png,jpg,bmp,jpeg,txt,text,db,gif,rb,py,mp3,wma,wav,ogg,flac,zip,rar,7z,pdf,htm,html,xls,doc,ppt,odt,ods,docx,xlsx,"
    "rtf,log,trashinfo,js,css,rs,aac,txt~,sh,DS_Store,kdenlive,part,webp,srt"
).split(",")
SORTINGS = ("num-matches", "num-matches-rev", "distance", "distance-rev", "duration", "duration-rev")
DISPLAYS = ("display_match_db_matches", "display_match_db_falsepos", "display_match_db_validation_failures")
MATCH_DB = ("matchdb_fix_moved_files", "matchdb_remove_known_matches", "matchdb_remove_falsepos", "matchdb_show_missed_matches")


@dataclass(frozen=True)
class Folders:
    candidates: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = tuple(EXCLUDED)

    def check(self) -> None:
        """Folders of one role each, and all of them there."""
        both = set(self.candidates) & set(self.references)
        if both:
            raise ValueError(f"folders in both roles: {sorted(both)}")
        gone = [f for f in (*self.candidates, *self.references, *self.exclude) if not os.path.exists(f)]
        if gone:
            raise FileNotFoundError(f"no such folders: {gone}")


@dataclass(frozen=True)
class Output:
    kind: str = "dups"  # or "none" or "unique"
    format: str = "normal"  # or "json"
    sort: str = "num-matches"
    cartesian: bool = False
    thumbnails: str | None = None
    gui: bool = False
    gui_trash: str | None = None
    gui_thumbs: int | None = None
    verbosity: str = "default"  # or "quiet" or "verbose"


@dataclass(frozen=True)
class Config:
    folders: Folders = field(default_factory=Folders)
    tolerance: float = CLI_TOLERANCE
    cropdetect: str = "none"
    skip_forward: float = SKIP_FORWARD
    hash_duration: float = HASH_DURATION
    cache: str | None = None
    update_cache: bool = True
    update_cache_only: bool = False
    reload: str = "none"  # or "errors" or "all"
    output: Output = field(default_factory=Output)
    match_db: str | None = None
    display: str | None = None  # or "matches", "falsepos" or "validation_failures"
    fix_moved_files: bool = False
    remove_known_matches: bool = False
    remove_falsepos: bool = False
    show_missed_matches: bool = False


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="twinreel", description="Finds near-duplicate videos.", allow_abbrev=False)
    several = {"nargs": "*", "action": "extend", "default": []}
    out.add_argument("--files", **several, help="folders and files to search")
    out.add_argument("--with-refs", **several, help="folders and files that others are compared with")
    out.add_argument("--exclude", **several, help="folders and files to leave out")
    out.add_argument("--exclude-exts", nargs="*", action="extend", default=None, help="extensions to leave out, separated by commas")
    for name in DISPLAYS:
        out.add_argument("--" + name.replace("_", "-"), action="store_true")
    out.add_argument("--tolerance", type=float, default=CLI_TOLERANCE)
    out.add_argument("--cropdetect", choices=("none", "letterbox", "motion"), default="none")
    out.add_argument("--skip-forward", type=float, default=SKIP_FORWARD)
    out.add_argument("--hash-duration", type=float, default=HASH_DURATION)
    out.add_argument("--cache-file")
    out.add_argument("--update-cache-only", action="store_true")
    out.add_argument("--no-update-cache", action="store_true")
    out.add_argument("--reload-errs", action="store_true")
    out.add_argument("--reload-all", action="store_true")
    out.add_argument("--cartesian", action="store_true")
    out.add_argument("--sort", choices=SORTINGS, default="num-matches")
    out.add_argument("--output", choices=("none", "unique", "dups"))
    out.add_argument("--output-format", choices=("normal", "json"), default="normal")
    out.add_argument("--match-thumbnails-dir")
    out.add_argument("--matchdb")
    for name in MATCH_DB:
        out.add_argument("--" + name.replace("_", "-"), action="store_true")
    out.add_argument("--quiet", action="store_true")
    out.add_argument("--verbose", action="store_true")
    out.add_argument("--gui-slint", action="store_true")
    out.add_argument("--gui-trash-path")
    out.add_argument("--gui-max-thumbs", type=int)
    out.add_argument("--args-file", help="a file of arguments, which replaces the command line")
    return out


def conflicts(given: argparse.Namespace) -> list[str]:
    """What of the options does not go together."""
    on = {k for k, v in vars(given).items() if v is True}
    flag = lambda name: "--" + name.replace("_", "-")
    out = [f"{flag(a)} and {flag(b)}" for i, a in enumerate(DISPLAYS) for b in (*DISPLAYS[i + 1 :], *MATCH_DB[1:]) if {a, b} <= on]
    out += [f"{flag(a)} and --no-update-cache" for a in ("update_cache_only", "reload_errs", "reload_all") if {a, "no_update_cache"} <= on]
    out += ["--quiet and --verbose"] if {"quiet", "verbose"} <= on else []
    return out + [f"{flag(a)} without --matchdb" for a in (*DISPLAYS, *MATCH_DB) if a in on and not given.matchdb]


def absolute(path: str, folder: str | None = None) -> str:
    """A path from ``folder``, or else the working folder, with links resolved
    where it exists."""
    joined = os.path.join(folder or os.getcwd(), path)
    return os.path.realpath(joined) if os.path.exists(joined) else joined


def arguments_of(text: str) -> list[str]:
    """The arguments in an arguments file: without comments, split as a shell does."""
    return shlex.split(strip_comments(text))


def read(arguments: Sequence[str]) -> Config:
    """The configuration that arguments ask for, or those of the file they name."""
    given = parser().parse_args(arguments)
    if given.args_file:
        with open(given.args_file) as file:
            given = parser().parse_args(arguments_of(file.read()))
    wrong = conflicts(given)
    if wrong:
        raise ValueError("; ".join(wrong))
    extensions = EXCLUDED if given.exclude_exts is None else [e for part in given.exclude_exts for e in part.split(",") if e]
    folders = Folders(*(tuple(absolute(p) for p in part) for part in (given.files, given.with_refs, given.exclude)), tuple(extensions))
    # who asks for no output in particular wants duplicates listed, unless they are shown otherwise
    kind = given.output or ("none" if given.gui_slint or given.match_thumbnails_dir else "dups")
    output = Output(
        kind, given.output_format, given.sort, given.cartesian, given.match_thumbnails_dir and absolute(given.match_thumbnails_dir), given.gui_slint,
        given.gui_trash_path, given.gui_max_thumbs, "quiet" if given.quiet else "verbose" if given.verbose else "default",
    )
    return Config(
        folders=folders, tolerance=given.tolerance, cropdetect=given.cropdetect, skip_forward=given.skip_forward, hash_duration=given.hash_duration,
        cache=given.cache_file, update_cache=not given.no_update_cache, update_cache_only=given.update_cache_only,
        reload="all" if given.reload_all else "errors" if given.reload_errs else "none", output=output, match_db=given.matchdb,
        display=next((d.removeprefix("display_match_db_") for d in DISPLAYS if getattr(given, d)), None), fix_moved_files=given.matchdb_fix_moved_files,
        remove_known_matches=given.matchdb_remove_known_matches, remove_falsepos=given.matchdb_remove_falsepos, show_missed_matches=given.matchdb_show_missed_matches,
    )
