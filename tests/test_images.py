import math

import numpy as np
import pytest

from plumbline.operators import embedding, neighbors
from plumbline.plans import config as c
from plumbline.plans.views import build_view
from plumbline.plans.workflows import run_tasks
from plumbline.sources.datasets import SourceFrames
from plumbline.sources.transforms import STEPS, apply_steps, checked, resize, weights

IMAGE = "struct<height:int,width:int,nChannels:int,data:binary>"


def row(values):
    return np.array(values, np.float64)[None, None, :, None]


@pytest.mark.parametrize(
    ("values", "width", "mode", "antialias", "wanted"),
    [
        ([0, 10], 4, "BILINEAR", False, [0, 2.5, 7.5, 10]), ([0, 10], 4, "BILINEAR", True, [0, 2.5, 7.5, 10]), ([0, 10, 20, 30], 2, "BILINEAR", False, [5, 25]),
        ([0, 10, 20, 30], 2, "BILINEAR", True, [50 / 7, 160 / 7]), ([0, 10, 20, 30], 2, "NEAREST", True, [0, 20]), ([0, 10, 20, 30], 2, "NEAREST_EXACT", True, [10, 30]),
        ([0, 10], 4, "BICUBIC", False, [-1.0546875, 2.265625, 7.734375, 11.0546875]), ([7, 7, 7], 5, "BICUBIC", True, [7] * 5), ([5], 3, "BICUBIC", True, [5] * 3),
    ],
)
def test_resampling_at_fixed_values(values, width, mode, antialias, wanted):
    assert np.allclose(resize(row(values), (1, width), mode, antialias=antialias)[0, 0, :, 0], wanted)


def test_weights_are_those_of_the_kernel():
    """Every weight by its own formula, for growing and shrinking; rows and columns apart."""
    for n, m in ((9, 4), (5, 13), (16, 16), (7, 1)):
        for antialias in (True, False):
            a, stretch = (-0.5, max(n / m, 1)) if antialias else (-0.75, 1)
            out = np.zeros((m, n))
            for i in range(m):
                at = (i + 0.5) * n / m - 0.5
                for j in range(math.floor(at) - 40, math.floor(at) + 40):
                    x = abs(j - at) / stretch
                    w = 1 - (a + 3) * x**2 + (a + 2) * x**3 if x < 1 else a * (x**3 - 5 * x**2 + 8 * x - 4) if x < 2 else 0
                    if 0 <= j < n or not antialias:
                        out[i, min(max(j, 0), n - 1)] += w
            assert np.allclose(weights(n, m, "BICUBIC", antialias), out / out.sum(1, keepdims=True))
    x = np.random.default_rng(1).normal(size=(3, 6, 9, 2))
    both = resize(x, (4, 5), "BILINEAR")
    assert np.allclose(both, np.einsum("ah,bw,nhwc->nabc", weights(6, 4, "BILINEAR", True), weights(9, 5, "BILINEAR", True), x))


def test_steps_by_name():
    x = (np.arange(2 * 3 * 4 * 3) * 3).astype(np.uint8).reshape(2, 3, 4, 3)
    one = lambda name, **params: np.stack(apply_steps(list(x), checked([{"type": name, "params": params}])))
    assert one("ToDtype", dtype="float32", scale=True).max() <= 1 and np.array_equal(one("ToDtype", dtype="float64"), x)
    assert np.allclose(one("ConvertImageDtype") * 255, x) and one("Resize", size=6).shape == (2, 6, 8, 3) and one("Resize", size=6, max_size=7).shape == (2, 5, 7, 3)
    back = apply_steps(list(x), checked([{"type": "ToDtype", "params": {"dtype": "float32", "scale": True}}, {"type": "ToDtype", "params": {"dtype": "uint8", "scale": True}}]))
    assert np.array_equal(np.stack(back), x)
    f = [{"step": "ToDtype", "params": {"dtype": "float32"}}, {"step": "Normalize", "params": {"mean": [1, 2, 3], "std": [1, 2, 4]}}]
    assert np.allclose(np.stack(apply_steps(list(x), checked(f))), (x - np.array([1, 2, 3])) / np.array([1, 2, 4]))
    assert one("CenterCrop", size=2).shape == (2, 2, 2, 3) and np.array_equal(one("CenterCrop", size=[1, 2])[0, 0], x[0, 1, 1:3]) and one("CenterCrop", size=5).shape == (2, 5, 5, 3)
    assert one("Pad", padding=[1, 2]).shape == (2, 7, 6, 3) and one("Pad", padding=1, fill=9)[0, 0, 0, 0] == 9 and one("Grayscale").shape == (2, 3, 4, 1)
    assert one("Grayscale")[0, 1, 1, 0] == int(x[0, 1, 1] @ [0.2989, 0.587, 0.114]) and one("RGB").shape == x.shape and one("ToImage").dtype == np.uint8
    for name, params, what in (("Nope", {}, "unknown transform"), ("Resize", {"size": 2, "interpolation": "LANCZOS"}, "interpolation"), ("ToDtype", {"dtype": "bfloat16"}, "dtype"), ("Normalize", {"mean": [0], "std": [1]}, "floating"), ("Pad", {"padding": 1, "padding_mode": "x"}, "padding_mode")):
        with pytest.raises(ValueError, match=what):
            one(name, **params)


def textures(seed, n):
    """Images of stripes this way and that, of a checkerboard, and of noise, at any phase."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        kind, phase = i % 4, rng.integers(0, 8)
        y, x = np.mgrid[0:88, 0:72] + phase
        grey = {0: (x // 3) % 2, 1: (y // 3) % 2, 2: (x // 4 + y // 4) % 2, 3: rng.random((88, 72))}[kind] * 200.0 + rng.normal(0, 6, (88, 72))
        out.append((i, kind, np.repeat(np.clip(grey, 0, 255).astype(np.uint8)[..., None], 3, 2)))
    return out


def frame(spark, images):
    rows = [(i, kind, (*x.shape, bytearray(x.tobytes())) if x is not None else None) for i, kind, x in images]
    return spark.createDataFrame(rows, f"item_index long, class_label int, image {IMAGE}")


def test_visual_words_tell_textures_apart(spark):
    df = frame(spark, [*textures(1, 60), (60, None, None)])
    words = embedding.vocabulary(df, 24, seed=3)
    assert words.shape == (24, embedding.WIDTH)
    made = embedding.bag_of_words(df, words, 32).checkpoint()
    rows = {r.item_index: (r.class_label, np.array(r.embedding) if r.embedding else None) for r in made.collect()}
    assert rows[60] == (None, None)
    for i, kind, x in textures(1, 60)[:8]:
        found = embedding.descriptors(x)
        near = [min(range(len(words)), key=lambda j: ((p - words[j]) ** 2).sum()) for p in found]
        assert np.allclose(rows[i][1], np.pad(np.bincount(near, minlength=24) / len(near), (0, 8)), atol=1e-6)
    near = neighbors.knn(made.filter("item_index < 60"), made.filter("item_index < 60"), "item_index", "embedding", 3).collect()
    assert np.mean([rows[r.item_index][0] == rows[r.neighbor][0] for r in near]) > 0.95
    seen, new = made.filter("class_label in (0, 1)"), made.filter("class_label in (0, 2)")
    odd = {r.item_index: r.is_ood for r in neighbors.ood_knn(new.filter("item_index % 3 = 0"), seen.filter("item_index % 3 <> 0"), "item_index", "embedding", 3).collect()}
    assert np.mean([odd[i] for i in odd if rows[i][0] == 2]) == 1.0 and np.mean([odd[i] for i in odd if rows[i][0] == 0]) < 0.5


def test_descriptors_of_odd_images():
    assert not embedding.descriptors(np.full((20, 20, 1), 7, np.uint8)).any()
    assert embedding.descriptors(np.zeros((3, 2, 4), np.uint8)).shape == (1, embedding.WIDTH)
    x = np.random.default_rng(2).integers(0, 255, (64, 48, 3), dtype=np.uint8)
    found = embedding.descriptors(x)
    assert found.shape == (7 * 5, embedding.WIDTH) and np.allclose(np.linalg.norm(found, axis=1), 1)
    assert np.allclose(found, embedding.descriptors(x.astype(np.float64) * 0.5 + 20))  # light and contrast don't matter


def test_views_keep_types_and_channel_order(spark):
    x = np.zeros((4, 6, 3), np.uint8)
    x[..., 2] = 250  # the source's order is blue, green, red
    df = frame(spark, [(0, 0, x), (1, 0, None)])
    steps = [{"type": "Resize", "params": {"size": [2, 3], "interpolation": "BICUBIC"}}, {"type": "ToDtype", "params": {"dtype": "float32", "scale": True}}, {"type": "SelectChannels", "params": {"channels": [0]}}]
    rows = build_view(df, steps, "item_index").orderBy("view_pos").collect()
    assert rows[0].image.dtype == "float32" and np.allclose(np.frombuffer(rows[0].image.data, np.float32), 250 / 255) and rows[0].image.nChannels == 1
    assert rows[1].image.data is None and set(STEPS) >= {"Resize", "CenterCrop", "Normalize"}
    assert embedding.flattened(df).collect()[0].embedding[:3] == [250.0, 0.0, 0.0]


def test_extractors_in_a_configuration(spark):
    known, new = frame(spark, [t for t in textures(1, 80) if t[1] < 2]), frame(spark, [(100 + i, k, x) for i, k, x in textures(2, 40) if k in (0, 2)])
    raw = {
        "datasets": [{"name": "one", "path": "x"}, {"name": "two", "path": "y"}], "sources": [{"name": "a", "dataset": "one"}, {"name": "b", "dataset": "two"}],
        "preprocessors": [{"name": "small", "steps": [{"step": "Resize", "params": {"size": 64}}, {"step": "Grayscale"}]}],
        "extractors": [{"name": "words", "model": "bovw", "vocab_size": 256, "preprocessor": "small"}, {"name": "flat", "model": "flatten", "preprocessor": "small"}],
        "workflows": [{"name": "w", "type": "ood-detection", "detectors": [{"method": "knn", "k": 3}], "metadata_insights": False}],
        "tasks": [{"name": "t", "workflow": "w", "sources": ["a", "b"], "extractor": "words"}, {"name": "f", "workflow": "w", "sources": ["a", "b"], "extractor": "flat"}, {"name": "u", "workflow": "w", "sources": ["a", "b"], "extractor": "none"}],
    }
    frames = {"one": SourceFrames(known), "two": SourceFrames(new)}
    by_words, flat, unknown = run_tasks(spark, c.Pipeline.model_validate(raw), frames=frames)
    assert by_words.success and flat.success, (by_words.errors, flat.errors)
    assert not unknown.success and "extractors" in unknown.errors[0]
    assert "warning" in {f.severity for f in by_words.findings}, by_words.findings
    with pytest.raises(ValueError, match="vocab_size"):
        c.Extractor(name="x", model="bovw", vocab_size=9)
