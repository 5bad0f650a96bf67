import numpy as np
import pytest

import twinreel
from twinreel import cli, config
from twinreel.sources import frames, match_store


def test_defaults_and_conflicts(tmp_path):
    found = config.read(["--files", "a", "/b/../c", "--with-refs", "r"])
    assert found.folders.candidates == (config.absolute("a"), "/b/../c") and found.output.kind == "dups" and found.cropdetect == "none" and found.tolerance == 0.3
    assert "py" in found.folders.exclude_extensions and config.read(["--exclude-exts", "x,y", "z"]).folders.exclude_extensions == ("x", "y", "z")
    assert config.read(["--gui-slint"]).output.kind == "none" and config.read(["--gui-slint", "--output", "unique"]).output.kind == "unique"
    assert config.read(["--reload-errs"]).reload == "errors" and config.read(["--matchdb", "d", "--display-match-db-falsepos"]).display == "falsepos"
    for wrong in (["--quiet", "--verbose"], ["--reload-all", "--no-update-cache"], ["--matchdb-remove-falsepos"], ["--matchdb", "d", "--display-match-db-matches", "--matchdb-remove-falsepos"]):
        with pytest.raises(ValueError):
            config.read(wrong)
    (tmp_path / "args").write_text("--files '/a b' # a comment\n--tolerance 0.2 --sort distance\n")
    read = config.read(["--args-file", str(tmp_path / "args"), "--tolerance", "0.9"])  # the file replaces the line
    assert read.folders.candidates == ("/a b",) and read.tolerance == 0.2 and read.output.sort == "distance"


def test_folders(tmp_path):
    with pytest.raises(FileNotFoundError):
        config.Folders((str(tmp_path), "/no/such")).check()
    with pytest.raises(ValueError):
        config.Folders((str(tmp_path),), (str(tmp_path),)).check()


def test_absolute(tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    assert config.absolute("link", str(tmp_path)) == str(tmp_path / "real") and config.absolute("none", str(tmp_path)) == f"{tmp_path}/none"


def clip(seed):
    r = np.random.default_rng(seed)
    return [r.integers(0, 256, (16, 16)).astype(np.uint8) for _ in range(40)]


def test_run(spark, tmp_path):
    videos = {"c/one.mp4": clip(1), "c/copy.mp4": clip(1), "c/other.mp4": clip(2), "c/broken.mp4": [None, *clip(3)], "r/ref.mp4": clip(2)}
    for name in videos:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    source = frames.MemoryFrames({f"{tmp_path}/{n}": v for n, v in videos.items()}, rate=10.0)  # four seconds each
    base = ["--cache-file", f"{tmp_path}/cache", "--matchdb", f"{tmp_path}/db"]

    def run(*arguments):
        out = cli.run(spark, config.read([*base, *arguments]), source)
        return out and sorted({(r["group_id"], r["path"].removeprefix(f"{tmp_path}/")) for r in out.collect()}, key=lambda r: r[1]) if out is not None and "group_id" in out.columns else out

    mine = ["--files", f"{tmp_path}/c"]
    assert [p for _, p in run(*mine)] == ["c/copy.mp4", "c/one.mp4"]
    assert run(*mine, "--update-cache-only") is None
    assert [p for _, p in run(*mine, "--no-update-cache", "--with-refs", f"{tmp_path}/r")] == []  # the reference is not hashed yet
    assert [p for _, p in run(*mine, "--with-refs", f"{tmp_path}/r")] == ["c/other.mp4", "r/ref.mp4"]
    unique = run(*mine, "--output", "unique").collect()
    assert [r["path"].removeprefix(f"{tmp_path}/") for r in unique] == ["c/other.mp4"]
    pair = [("falsepos", 0, f"{tmp_path}/c/one.mp4"), ("falsepos", 0, f"{tmp_path}/c/copy.mp4")]
    match_store.MatchStore(spark, f"{tmp_path}/db").merge(spark.createDataFrame(pair, "verdict string, set_id bigint, path string"))
    assert run(*mine, "--matchdb-remove-falsepos") == []
    shown = run(*mine, "--display-match-db-falsepos").collect()
    assert [(r["lo"][-8:], r["hi"][-7:]) for r in shown] == [("copy.mp4", "one.mp4")]


def test_names_of_the_package():
    assert all(getattr(twinreel, name) is not None for name in twinreel.__all__)
    with pytest.raises(AttributeError):
        twinreel.no_such_name  # noqa: B018
