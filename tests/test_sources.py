import subprocess

import pytest
from pyspark.sql import functions as F

from twinreel.operators import resolution
from twinreel.sources import cache_store, frames, listing, match_store, sinks
from twinreel.streaming import updates

GROUPS = [(1, "/a/x.mp4", False), (1, "/b/longer.mp4", False), (2, "/r/ref.mp4", True), (2, "/c/y.avi", False)]


def groups(spark):
    return spark.createDataFrame(GROUPS, "group_id bigint, path string, is_reference boolean")


def test_sinks(spark, tmp_path):
    texts = {r["group_id"]: r["text"] for r in sinks.text_lines(groups(spark)).collect()}
    assert texts == {1: "/a/x.mp4\n/b/longer.mp4\n", 2: "/r/ref.mp4\n/c/y.avi\n"}
    objects = {r["group_id"]: r["json"] for r in sinks.json_objects(groups(spark)).collect()}
    assert objects[1] == '{"reference":null,"duplicates":["/a/x.mp4","/b/longer.mp4"]}'
    sinks.write_json(groups(spark), f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_verdicts(spark, tmp_path):
    index = tmp_path / "idx.json"
    index.write_text('[{"idx": 9, "matchset": ["/a", "/b"]}, {"idx": 0, "matchset": ["/c", "/d"]}]')
    rows = sinks.read_verdicts(spark, str(index), spark.createDataFrame([("confirmed", 1)], "verdict string, number bigint")).collect()
    assert sorted(r["path"] for r in rows) == ["/c", "/d"]
    with pytest.raises(Exception, match="no such place"):
        sinks.read_verdicts(spark, str(index), spark.createDataFrame([("confirmed", 5)], "verdict string, number bigint")).collect()


def test_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("same")
    (tmp_path / "b.txt").write_text("same")
    rows = listing.list_files(spark, str(tmp_path)).collect()
    assert sorted((r["path"], r["size"]) for r in rows) == [(f"{tmp_path}/b.txt", 4), (f"{tmp_path}/d/a.txt", 4)]
    assert len({r["content_hash"] for r in listing.content_hashes(spark, str(tmp_path)).collect()}) == 1


def test_cache_store_and_stream(spark, tmp_path):
    store = cache_store.CacheStore(spark, f"{tmp_path}/cache")
    assert store.load().count() == 0
    for n, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2), ("b", 9), ("c", 1)]]):
        spark.createDataFrame(rows, "path string, mtime bigint").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("path string, mtime bigint").parquet(f"{tmp_path}/in")
        made = lambda df, n=n: df.select("path", "mtime", F.lit(n).alias("duration"), F.lit(None).cast("array<bigint>").alias("hash"), F.lit(None).cast("string").alias("err_kind"), F.lit(None).cast("string").alias("err_msg"))
        updates.maintain(stream, store.load, store.append, made, f"{tmp_path}/check").awaitTermination()
    assert {r["path"]: (r["mtime"], r["duration"]) for r in store.load().collect()} == {"a": (1, 0), "b": (9, 1), "c": (1, 1)}
    store.save(store.load().where("path <> 'a'"))
    assert {r["path"] for r in store.load().collect()} == {"b", "c"}
    with pytest.raises(cache_store.CacheMismatch):
        cache_store.CacheStore(spark, f"{tmp_path}/cache", duration=5.0).load()


def test_resolution_plan(spark):
    ordered = resolution.review_order(groups(spark))
    assert {r["path"]: r["entry_idx"] for r in ordered.collect()} == {"/a/x.mp4": 0, "/b/longer.mp4": 1, "/r/ref.mp4": 0, "/c/y.avi": 1}
    def plan(*rows):
        return sorted((r["action"], r["src"], r["dst"], r["error"]) for r in resolution.plan(ordered, spark.createDataFrame(rows, "group_id bigint, text string")).collect())
    assert plan((1, "0 as 1")) == [("move", "/a/x.mp4", "/b/longer.mp4", None), ("trash", "/b/longer.mp4", "/trash/b/longer.mp4", None)]
    assert plan((1, "0as1at0")) == [("move", "/a/x.mp4", "/a/longer.mp4", None), ("trash", "/b/longer.mp4", "/trash/b/longer.mp4", None)]
    assert plan((1, "0")) == [("trash", "/b/longer.mp4", "/trash/b/longer.mp4", None)]
    assert [r[0] for r in plan((1, "u1"))] == ["error"]
    assert [r[0] for r in plan((1, "7"))] == ["error"] and [r[0] for r in plan((1, "what"))] == ["error"]


def test_trash_and_what_exists(spark):
    rows = [(1, "/a/x.mp4", False), (1, "/trash/b/y.mp4", False), (2, "/c/k.mp4", False), (2, "/c/long.avi", False), (3, "/d/one", False), (3, "/d/one", False)]
    ordered = resolution.review_order(spark.createDataFrame(rows, "group_id bigint, path string, is_reference boolean"))
    listed = [("/a/x.mp4", "x"), ("/trash/b/y.mp4", "y"), ("/c/k.mp4", "k"), ("/c/long.avi", "l"), ("/trash/c/long.avi", "l"), ("/trash/c/k.mp4", "other"), ("/trash/c/k (1).mp4", "p"), ("/trash/c/k (3).mp4", "q")]
    files = spark.createDataFrame(listed, "path string, content_hash string")

    def plan(group, text):
        table = spark.createDataFrame([(group, text)], "group_id bigint, text string")
        return sorted((r["action"], r["src"], r["dst"], r["error"]) for r in resolution.plan(ordered, table, files=files).collect())

    assert plan(1, "u1") == [("untrash", "/trash/b/y.mp4", "/b/y.mp4", None)]
    assert plan(1, "0")[0][3] == "already in the trash"
    assert plan(2, "0") == [("delete", "/c/long.avi", None, None)]  # its equal is in the trash
    assert plan(2, "1") == [("trash", "/c/k.mp4", "/trash/c/k (2).mp4", None)]
    assert plan(2, "0 as 1") == [("delete", "/c/long.avi", None, None), ("move", "/c/k.mp4", "/c/long.mp4", None)]
    assert plan(3, "0")[0][3] == "a file is listed twice"
    assert [tuple(r) for r in resolution.duplicated_entries(ordered).collect()] == [(3, "/d/one")]


def test_a_plan_carried_out(tmp_path):
    for name in ("a.mp4", "b.mp4", "c.mp4"):
        (tmp_path / name).write_text(name)
    at = lambda name: str(tmp_path / name)
    done = resolution.execute([("move", at("a.mp4"), at("b.mp4")), ("trash", at("b.mp4"), at("trash/b.mp4")), ("delete", at("c.mp4"), None), ("error", None, None)])
    assert [d[0] for d in done] == ["delete", "trash", "move"] and (tmp_path / "b.mp4").read_text() == "a.mp4" and (tmp_path / "trash/b.mp4").read_text() == "b.mp4"
    (tmp_path / "a.mp4").write_text("again")
    assert resolution.move_file(at("a.mp4"), at("b.mp4")) == at("b (1).mp4")
    with pytest.raises(FileNotFoundError):
        resolution.move_file(at("none"), at("x"))


def test_frames_in_memory():
    source = frames.MemoryFrames({"v": list(range(10))})
    assert list(source.frames("v", 2.0, 1.5, 4)) == [3, 4, 5, 6]
    assert "-ss" not in frames.FfmpegFrames().command("v", 1.0, 0.9, 2)


def test_a_frame_is_read_whole_or_in_time():
    source = frames.FfmpegFrames(timeout=0.5)
    process = subprocess.Popen(["sh", "-c", "printf abc; sleep 0.1; printf defgh; sleep 5"], stdout=subprocess.PIPE)
    assert source.read(process, 6) == b"abcdef"
    with pytest.raises(TimeoutError):
        source.read(process, 6)
    process.kill()
    assert source.read(subprocess.Popen(["printf", "ab"], stdout=subprocess.PIPE), 6) == b"ab"
    with pytest.raises(RuntimeError, match="no such thing"):
        frames.run(["sh", "-c", "echo no such thing >&2; exit 3"], 5)


def test_walk(spark, tmp_path):
    for name in ("a/x.mp4", "a/.hidden/y.mp4", "a/skip.py/z.mp4", "a/b/c/w.AVI", "a/b/notes.txt", "out/v.mp4", "repo/.git/config", "repo/build/q.mp4", "repo/keep/build.mp4", "repo/r.log.mp4"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "repo/.gitignore").write_text("# rules\nbuild/\n*.log.*\n!none\n")
    (tmp_path / "a/b/.ignore").write_text("/c/**\n")
    found = listing.walk(spark, [str(tmp_path)], [str(tmp_path / "out")], ["py", "TXT"])
    assert {r["path"].removeprefix(f"{tmp_path}/") for r in found.collect()} == {"a/x.mp4", "repo/keep/build.mp4"}
    with pytest.raises(FileNotFoundError):
        listing.walk(spark, [str(tmp_path / "none")])


def test_ignore_rules():
    rules = listing.ignore_rules("*.tmp\n!keep.tmp\n/top\ndocs/*.md\n**/deep/?.x\n[!a]bc\n", "/r")
    hit = {p for p in ("/r/a.tmp", "/r/d/b.tmp", "/r/keep.tmp", "/r/top", "/r/d/top", "/r/docs/a.md", "/r/docs/s/a.md", "/r/x/deep/y.x", "/r/xbc", "/r/abc") if listing.ignored(p, False, rules)}
    assert hit == {"/r/a.tmp", "/r/d/b.tmp", "/r/top", "/r/docs/a.md", "/r/x/deep/y.x", "/r/xbc"}


def test_match_store(spark, tmp_path):
    store = match_store.MatchStore(spark, f"{tmp_path}/db", keep=2)
    assert store.load()["confirmed"].count() == 0
    rows = [("confirmed", 0, "/a"), ("confirmed", 0, "/b"), ("confirmed", 1, "/b"), ("confirmed", 1, "/c"), ("confirmed", 2, "/d"), ("confirmed", 2, "/e"), ("falsepos", 3, "/x"), ("falsepos", 3, "/y")]
    store.merge(spark.createDataFrame(rows, "verdict string, set_id bigint, path string"))
    groups_of = lambda: sorted(sorted(r["p"]) for r in store.load()["confirmed"].groupBy("component_id").agg(F.collect_list("path").alias("p")).collect())
    assert groups_of() == [["/a", "/b", "/c"], ["/d", "/e"]] and [tuple(r) for r in store.load()["rejected"].collect()] == [("/x", "/y")]
    store.merge(spark.createDataFrame([("unmatch", 0, "/a"), ("unmatch", 0, "/c")], "verdict string, set_id bigint, path string"))
    assert groups_of() == [["/d", "/e"]]
    store.save({"contents": spark.createDataFrame([("/d", 1, "D"), ("/e", 1, "E")], match_store.TABLES["contents"])})
    store.fix_moved(spark.createDataFrame([("/d", 1, "D"), ("/new/e", 1, "E"), ("/x", 1, "X")], match_store.TABLES["contents"]))
    assert groups_of() == [["/d", "/new/e"]] and store.load()["rejected"].count() == 0 and len(store.versions()) == 2
    store.prune(spark.createDataFrame([("/d",)], "path string"))
    assert groups_of() == []
