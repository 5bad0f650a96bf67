import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinreel.media import crop as C
from twinreel.media import transform as T
from twinreel.media.hashing import CreationOptions, hash_video, hash_videos, text_frames


def sides(c):
    return c.left, c.right, c.top, c.bottom


def spots(shape, **at):
    out = np.zeros(shape, np.uint8)
    for (y, x), v in at.get("at", {}).items():
        out[y, x] = v
    return out


@pytest.mark.parametrize("value", [0, 255])
@pytest.mark.parametrize("bw", [True, False])
def test_plain_frames_have_no_letterbox(value, bw):
    assert sides(C.letterbox(np.full((3, 3), value, np.uint8), 1, bw)) == (0, 0, 0, 0)


@pytest.mark.parametrize(
    ("pixels", "tolerance", "bw", "expected"),
    [
        ([[127, 127, 127], [127, 0, 127], [127, 127, 127]], 1, True, (0, 0, 0, 0)),
        ([[127, 127, 127], [127, 0, 127], [127, 127, 127]], 1, False, (1, 1, 1, 1)),
        ([[120, 130, 120], [130, 0, 130], [120, 130, 120]], 9, False, (0, 0, 0, 0)),
        ([[120, 130, 120], [130, 0, 130], [120, 130, 120]], 10, False, (1, 1, 1, 1)),
        ([[0, 0, 0], [0, 127, 0], [0, 0, 0]], 10, True, (1, 1, 1, 1)),
        ([[127, 0, 0], [0, 0, 0], [0, 0, 0]], 1, False, (0, 2, 0, 2)),
        ([[0, 0, 200], [0, 0, 120], [0, 0, 100]], 10, True, (2, 0, 0, 0)),
        ([[0, 0, 0], [0, 127, 0], [0, 0, 127]], 10, True, (1, 0, 1, 0)),
    ],
)
def test_letterbox(pixels, tolerance, bw, expected):
    assert sides(C.letterbox(np.array(pixels, np.uint8), tolerance, bw)) == expected


def boxed():
    frame = np.zeros((6, 5), np.uint8)
    frame[1:4, 1:4] = 255
    return frame


def ring(inner, height=4):
    frame = np.full((height, 4), 255, np.uint8)
    for top in range(0, height, 4):
        frame[top, 1:3] = 220
        frame[top + 1 : top + 3, [0, 3]] = 220
    for (y, x), v in inner.items():
        frame[y, x] = v
    return frame


def square(y, v):
    return {(y + i, 1 + j): v for i in range(2) for j in range(2)}


def test_motion_without_motion():
    assert sides(C.motion_crop([np.full((3, 3), 255, np.uint8)] * 2)) == (0, 0, 0, 0)
    assert sides(C.motion_crop([boxed()] * 2)) == (1, 1, 1, 2)


def test_motion_square():
    assert sides(C.motion_crop([ring(square(1, 80)), ring(square(1, 27))])) == (1, 1, 1, 1)


def test_motion_prefers_the_larger_region():
    frames = [ring({(1, 1): v, (1, 2): 255, (2, 1): 255, (2, 2): 255} | square(5, v), 8) for v in (80, 20)]
    assert sides(C.motion_crop(frames)) == (1, 1, 5, 1)


def test_regions_touch_at_corners():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 0]], np.uint8)
    label = C.regions(mask)
    assert label.max() == 3 and label[0, 0] == label[1, 1] and label[0, 3] == label[1, 3]
    assert C.regions(np.ones((3, 3), np.uint8)).tolist() == [[1] * 3] * 3
    assert C.largest_region(np.zeros((2, 2), np.uint8)) is None


def test_crop_algebra():
    whole = C.Crop(100, 100)
    assert whole.view() == (0, 0, 100, 100) and whole.uncropped()
    assert C.Crop(768, 432, 96, 96).view() == (96, 0, 576, 432)
    assert C.Crop.from_corner(100, 100, 11, 12, 13, 14).view() == (11, 12, 13, 14)
    assert C.Crop(3, 3, 1, 1, 1, 1).eroded() is None
    with pytest.raises(ValueError):
        C.Crop(4, 4, 2, 2)


def test_dct_against_its_definition():
    rng = np.random.default_rng(0)
    values = rng.normal(size=(4, 4, 4))
    n = np.arange(4)
    direct = np.zeros((4, 4, 4))
    for t in range(4):
        for x in range(4):
            for y in range(4):
                a, b, c = (np.cos(np.pi * k * (2 * n + 1) / 8) for k in (t, x, y))
                direct[t, x, y] = (values * a[:, None, None] * b[None, :, None] * c[None, None, :]).sum()
    assert np.allclose(T.dct3(values), direct)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.booleans(), min_size=1000, max_size=1000))
def test_words_round_trip(bits):
    assert T.bits_of(T.words(np.array(bits))).tolist() == [int(b) for b in bits]


def test_hash_tells_videos_apart_and_survives_noise():
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:64, 0:48]
    video = [np.uint8(127 + 100 * np.sin((x + 3 * t) / 9) * np.cos(y / 7)) for t in range(16)]
    noisy = [np.uint8(np.clip(f + rng.normal(0, 4, f.shape), 0, 255)) for f in video]
    other = [np.uint8(127 + 100 * np.cos((y * 2 - t) / 5)) for t in range(16)]
    a, b, c = (T.bits_of(hash_video(v, CreationOptions(cropdetect="none"))[0]) for v in (video, noisy, other))
    assert (a != b).mean() < 0.3 < (a != c).mean()
    assert hash_video(video[:15], CreationOptions())[1] == "NotEnoughFrames"
    assert hash_video([*video[:8], *[f[:32] for f in video[8:]]], CreationOptions())[1] == "VidProc"


def test_static_video_has_no_noise_bits():
    bits = T.bits_of(T.hash_frames([np.full((16, 16), 200, np.uint8)] * 16))
    assert bits.sum() == 1 and bits[0]


def test_hash_videos_operator(spark):
    docs = spark.createDataFrame([(1, "x" * 1024), (2, "short"), (3, None), (4, "".join(chr(32 + i % 90) for i in range(2000)))], "doc_id bigint, text string")
    rows = {r["path"]: r for r in hash_videos(text_frames(docs), CreationOptions(cropdetect="none")).collect()}
    assert rows["/doc/2"]["err_kind"] == rows["/doc/3"]["err_kind"] == "NotEnoughFrames"
    assert rows["/doc/4"]["err_kind"] is None and len(rows["/doc/4"]["hash"]) == 16


EDGE = [255, 220, 220, 255]


@pytest.mark.parametrize(
    ("first", "second", "expected"),
    [
        # two regions, the larger one is chosen
        ([EDGE, [220, 80, 255, 220], [220, 255, 255, 220], [255] * 4, EDGE, [220, 80, 80, 220], [220, 80, 80, 220], [255] * 4],
         [EDGE, [220, 20, 255, 220], [220, 255, 255, 220], [255] * 4, EDGE, [220, 20, 20, 220], [220, 20, 20, 220], [255] * 4], (1, 1, 5, 1)),
        # two of nearly equal areas, the upper one is chosen
        ([EDGE, [220, 80, 80, 220], [220, 255, 80, 220], [255] * 4, EDGE, [220, 80, 80, 220], [220, 80, 80, 220], [255] * 4],
         [EDGE, [220, 20, 255, 220], [220, 20, 255, 220], [255] * 4, EDGE, [220, 20, 20, 220], [220, 20, 20, 220], [255] * 4], (1, 1, 1, 5)),
        # one pixel in the top left corner
        ([[80, 220, 220, 255], [220, 255, 255, 220], [220, 255, 255, 220], [255] * 4, EDGE, [220, 255, 255, 220], [220, 255, 255, 220], [255, 220, 255, 255]],
         [[20, 220, 220, 255], [220, 255, 255, 220], [220, 255, 255, 220], [255] * 4, EDGE, [220, 255, 255, 220], [220, 255, 255, 220], [255] * 4], (0, 3, 0, 7)),
        # a square in the bottom right corner
        ([EDGE, [220, 255, 255, 220], [220, 255, 255, 220], [255] * 4, EDGE, [220, 255, 255, 220], [220, 255, 20, 20], [255, 255, 20, 20]],
         [EDGE, [220, 255, 255, 220], [220, 255, 255, 220], [255] * 4, EDGE, [220, 255, 255, 220], [220, 255, 40, 20], [255, 255, 20, 40]], (2, 0, 6, 0)),
    ],
)
def test_motion_regions(first, second, expected):
    assert sides(C.motion_crop([np.array(f, np.uint8) for f in (first, second)])) == expected


def test_motion_needs_two_frames_of_a_size():
    frame = np.zeros((8, 8), np.uint8)
    assert C.motion_crop([frame]) is None and C.motion_crop([frame, np.zeros((9, 8), np.uint8)]) is None


def test_an_unfair_crop_leaves_the_letterbox(monkeypatch):
    crops = iter([C.Crop(100, 100, 45, 45, 0, 0), C.Crop(100, 100, 0, 0, 40, 40)])  # 10 x 100 and 100 x 20
    monkeypatch.setattr(C, "motion_pass", lambda frames: next(crops))
    r = np.random.default_rng(0)
    frames = [r.integers(0, 256, (100, 100)).astype(np.uint8) for _ in range(2)]
    assert sides(C.motion_crop(frames)) == (0, 0, 0, 0)


def test_luma_is_cut_off():
    assert T.luma(np.array([[[255, 255, 255], [1, 1, 1], [10, 20, 30]]], np.uint8)).tolist() == [[255, 1, 18]]


def test_grids():
    from twinreel.media import compositing as G

    a, b = np.full((2, 3), 1, np.uint8), np.full((2, 3), 2, np.uint8)
    assert G.side_by_side([a, b]).tolist() == [[1, 1, 1, 2, 2, 2]] * 2 and G.stacked([a, b]).tolist() == [[1] * 3] * 2 + [[2] * 3] * 2
    assert G.grid([[a], [b, b]]).tolist() == [[1] * 3 + [0] * 3] * 2 + [[2] * 6] * 2 and G.grid([[], []]) is None and G.side_by_side([]) is None
    with pytest.raises(ValueError):
        G.grid([[a, a.T]])
    assert G.grid([[np.zeros((2, 2, 3), np.uint8)] * 2]).shape == (2, 4, 3)


def test_edges():
    from twinreel.media import compositing as G

    assert G.edge_pixels(np.full((40, 40), 9, np.uint8), 80) == 0
    square = np.zeros((60, 60), np.uint8)
    square[20:40, 20:40] = 255
    found = G.edges(square)
    ys, xs = np.nonzero(found)
    assert 60 <= found.sum() <= 200 and ys.min() >= 17 and ys.max() <= 42 and xs.min() >= 17 and xs.max() <= 42 and not found[25:35, 25:35].any()
    faint = np.zeros((60, 60), np.uint8)
    faint[:, 30:] = 3  # too weak to stand alone
    assert not G.edges(faint).any()
