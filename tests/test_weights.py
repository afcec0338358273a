"""Tensor files: written and read back, and files that are none."""

import json

import numpy as np
import pytest

from topicloom.sources import weights


def _file(path, tensors, cut=0):
    head, data = {"__metadata__": {"format": "pt"}}, b""
    for name, (kind, x) in tensors.items():
        head[name] = {"dtype": kind, "shape": list(x.shape), "data_offsets": [len(data), len(data) + x.nbytes]}
        data += x.tobytes()
    text = json.dumps(head).encode()
    whole = len(text).to_bytes(8, "little") + text + data
    path.write_bytes(whole[: len(whole) - cut])
    return str(path)


def test_headers_and_rows(spark, tmp_path):
    x = np.arange(60, dtype="<f4").reshape(20, 3)
    path = _file(tmp_path / "a.safetensors", {"bert.w": ("F32", x), "n": ("I64", np.array([7, 8])), "none": ("F32", np.zeros((0, 3), "<f4")), "one": ("F64", np.array(2.5))})
    heads = {r["name"]: (r["dtype"], r["shape"], r["end"] - r["start"]) for r in weights.tensors(spark, path).collect()}
    assert heads == {"bert.w": ("F32", [20, 3], 240), "n": ("I64", [2], 16), "none": ("F32", [0, 3], 0), "one": ("F64", [], 8)}
    rows = weights.tensor_rows(spark, path, 64)
    assert rows.rdd.getNumPartitions() > 4
    got = sorted((r["name"], r["row"], r["value"]) for r in rows.collect())
    assert got == [("bert.w", i, v.tolist()) for i, v in enumerate(x)] + [("n", 0, [7.0]), ("n", 1, [8.0]), ("one", 0, [2.5])]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_come_back(spark, tmp_path, kind):
    rows = [(i - 3, [i / 7, float(-i)]) for i in range(50)]
    df = spark.createDataFrame(rows, f"doc_id long, embedding array<{kind}>").repartition(3)
    path = f"file://{tmp_path}/v"
    weights.save_vectors(df, path, file_rows=16)
    weights.save_vectors(df, path, overwrite=True, file_rows=16)
    got = {r["doc_id"]: r["embedding"] for r in weights.load_vectors(spark, path).collect()}
    assert got == {r["doc_id"]: r["embedding"] for r in df.collect()} and weights.load_vectors(spark, path).count() == 50


def test_no_vectors_and_nulls(spark, tmp_path):
    weights.save_vectors(spark.createDataFrame([], "doc_id long, embedding array<float>"), f"{tmp_path}/none")
    assert weights.load_vectors(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="may not be null"):
        weights.save_vectors(spark.createDataFrame([(1, None)], "doc_id long, embedding array<float>"), f"{tmp_path}/null")


def test_files_that_are_none(spark, tmp_path):
    def made(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    check = weights.check_weight_file
    for path, why in [
        (made("p.safetensors", b"version https://git-lfs.github.com/spec/v1\noid sha256:0\nsize 9\n"), "LFS pointer"),
        (made("s.safetensors", b"<html>"), "too small"),
        (made("l.bin", b"\x80\x02" + bytes(1 << 20)), "legacy pickle"),
        (made("z.pt", b"PK\x03\x04" + bytes(1 << 20)), "a pickle"),
        (made("x.onnx", bytes(1 << 20)), "unknown format"),
        (str(tmp_path / "nowhere.bin"), "no file"),
    ]:
        with pytest.raises(weights.WeightFileError, match=why):
            check(path)
    short = _file(tmp_path / "c.safetensors", {"w": ("F32", np.zeros((8, 8), "<f4"))}, cut=5)
    for path, why in [(short, "is short"), (made("h.safetensors", bytes([255] * 16)), "no header"), (made("j.safetensors", (2).to_bytes(8, "little") + b"[]"), "can't be read")]:
        with pytest.raises(Exception, match=why):
            weights.tensors(spark, path).collect()


def test_parameters(spark):
    found = spark.createDataFrame([("bert.a.LayerNorm.gamma",), ("roberta.b",), ("cls.x",), ("model.auto_model.d",)], "name string")
    expected = spark.createDataFrame([("a.LayerNorm.weight",), ("b",), ("c",), ("d",)], "name string")
    got = {r["name"]: r["status"] for r in weights.match_parameters(found, expected).collect()}
    assert got == {"a.LayerNorm.weight": "loaded", "b": "loaded", "c": "missing", "cls.x": "extra", "d": "loaded"}
    with pytest.raises(weights.WeightFileError, match="1 expected"):
        weights.match_parameters(found, expected, strict=True)
