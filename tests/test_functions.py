import pytest
from pyspark.sql import functions as F

from twinreel.functions import crops, parsing, paths
from twinreel.operators import cache, curation, groups


def column(spark, expression, schema, *rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_prefixes_are_by_components(spark):
    assert column(spark, paths.under(F.col("p"), ["/a/b"]), "p string", ("/a/b",), ("/a/b/c",), ("/a/bc",), ("/a",)) == [True, True, False, False]


def test_extensions(spark):
    got = column(spark, paths.extension(F.col("p")), "p string", ("/x/A.PNG",), ("/x/.DS_Store",), ("/x.d/y",), ("/x/a.tar.gz",))
    assert got == ["png", "", "", "gz"]


def test_roles_must_not_overlap():
    with pytest.raises(ValueError):
        paths.roles(F.lit("/a"), ["/a"], ["/a/b"])
    with pytest.raises(ValueError):
        paths.roles(F.lit("/a"), ["/a/b"], [], ["/a"])


def test_instructions(spark):
    got = column(spark, parsing.instruction(F.col("t")), "t string", ("1 as 2 at 3",), ("1 at 3 as 2",), ("1 at 2",), ("1 as 2",), ("1",), ("u1",), ("x",), ("1as2at3",), (" 4at5 as6 ",), ("99999999999999999999 as 2",))
    assert [g and tuple(g) for g in got] == [
        (False, 2, 3, 1, None), (False, 2, 3, 1, None), (False, 1, 2, 1, None), (False, 2, 2, 1, None), (False, 1, 1, 1, None), (True, 1, 1, 1, None), None,
        (False, 2, 3, 1, None), (False, 6, 5, 4, None), (False, 2, 2, None, "contents_idx: 99999999999999999999"),
    ]
    texts = [("7 as 8 at 1",), ("u9",), ("1",), ("1 as 99999999999999999999",)]
    errors = column(spark, parsing.instruction_errors(parsing.instruction(F.col("t")), F.lit(6)), "t string", *texts)
    assert errors == ["basename index not valid: 8. contents index not valid: 7.", "basename index not valid: 9. dirname index not valid: 9. contents index not valid: 9.", "", "not a number: basename_idx: 99999999999999999999"]


def test_sampling_plan(spark):
    got = column(spark, parsing.sampling_plan(F.col("d")), "d double", (1.0,), (2.0,), (6.0,), (20.0,), (100.0,))
    assert [tuple(g) for g in got] == [(64 * 16384, 16384, 0.0), ((1 << 31) - 1, 16384, 0.0), (16 * 16384, 16384, 0.0), (104857, 16384, 8.0), (104857, 16384, 15.0)]


def test_metadata(spark):
    got = column(spark, parsing.parse_metadata(F.col("t")), "t string", ("Unix,FfmpegBackend,Letterbox,15,1",), ("a,b",), ("unix,other,none,x,1",))
    assert tuple(got[0]) == ("unix", "ffmpegbackend", "letterbox", 15.0, 1, None) and got[1] is None and got[2]["error"] == "backend: other"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a # b\nc", "a \nc"), ("#!/bin/sh\n# x\ny", "#!/bin/sh\n\ny"), ("a '# b' # c", "a '# b' "), ('a "# \\" #" # c', 'a "# \\" #" '),
        ("a\\# b", "a\\# b"), ("a#b", "a#b"), ("# only", ""), ("", ""),
    ],
)
def test_comments(text, expected):
    assert parsing.strip_comments(text) == expected


def test_crop_coordinates(spark):
    whole = crops.crop(*(F.lit(x) for x in (3, 3, 0, 0, 0, 0)))
    inner = crops.crop(*(F.lit(x) for x in (3, 3, 1, 1, 1, 1)))
    row = spark.range(1).select(F.size(crops.coordinates(whole)), F.size(crops.coordinates(whole, False)), crops.coordinates(inner), crops.erode(inner)).first()
    assert (row[0], row[1], [tuple(x) for x in row[2]], row[3]) == (9, 0, [(1, 1)], None)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (11, 12), *[(i, i + 1) for i in range(100, 160)]], "u bigint, v bigint")
    got = {r["id"]: r["component_id"] for r in curation.confirmed_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 11: 11, 12: 11} | {i: 100 for i in range(100, 161)}


def test_dropping_items(spark):
    confirmed = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "e")], "component_id bigint, path string")
    gone = spark.createDataFrame([("b",), ("d",)], "path string")
    assert sorted((r["component_id"], r["path"]) for r in curation.drop_items(confirmed, gone).collect()) == [(1, "a"), (1, "c")]
    assert curation.drop_component(confirmed, gone).count() == 0


def test_changes(spark):
    now = spark.createDataFrame([("same", 10), ("slack", 12), ("late", 13), ("early", 7), ("new", 1)], "path string, mtime bigint")
    then = spark.createDataFrame([("same", 10), ("slack", 10), ("late", 10), ("early", 10), ("gone", 1)], "path string, mtime bigint")
    got = {r["path"]: r["action"] for r in cache.changes(now, then).collect()}
    assert got == {"same": "keep", "slack": "keep", "late": "update", "early": "update", "new": "update", "gone": "remove"}


def test_filtering_members(spark):
    rows = [(1, "a", False), (1, "b", False), (2, "r", True), (2, "c", False), (3, "s", True), (3, "d", False)]
    table = spark.createDataFrame(rows, "group_id bigint, path string, is_reference boolean")
    got = groups.filter_members(table, ~F.col("path").isin("b", "s")).collect()
    assert sorted((r["group_id"], r["path"]) for r in got) == [(2, "c"), (2, "r")]
