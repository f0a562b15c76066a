"""Tensor files read by slices: many tasks, equal to the arrays written; digests that don't hang on slices or layout."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiteloom.sources import readers, tensors


def write(path, values, order=None, kind="F32"):
    header, body = {"__metadata__": {"format": "x"}}, b""
    for name in order or values:
        data = values[name].tobytes()
        header[name] = {"dtype": kind if isinstance(kind, str) else kind[name], "shape": list(values[name].shape), "data_offsets": [len(body), len(body) + len(data)]}
        body += data
    head = json.dumps(header).encode()
    path.write_bytes(len(head).to_bytes(8, "little") + head + body)
    return str(path)


def gathered(slices):
    out = {}
    for r in slices.orderBy("tensor", "first").collect():
        own = out.setdefault(r.tensor, (r.shape, r.dtype, []))[2]
        assert r.first == len(own)
        own += r["values"]
    return out


@pytest.fixture
def some():
    rng = np.random.default_rng(1)
    return {"b": rng.normal(size=(50, 7)).astype("<f4"), "a": np.arange(1000, dtype="<f4"), "none": np.zeros((0, 3), "<f4"), "one": np.array(2.5, "<f4")}


def test_slices_equal_the_arrays(spark, tmp_path, some):
    path = write(tmp_path / "x.safetensors", some)
    for split, size in ((1 << 20, 1 << 18), (400, 33), (1, 1000)):
        slices = tensors.read_slices(spark, path, split, size)
        found = gathered(slices)
        assert found.keys() == some.keys()
        for name, (shape, dtype, values) in found.items():
            assert shape == list(some[name].shape) and dtype == "F32" and values == some[name].reshape(-1).tolist()
        if split == 400:
            assert slices.rdd.getNumPartitions() >= 10


def test_number_types(spark, tmp_path):
    kinds = {"F64": "<f8", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "|i1", "U8": "|u1"}
    values = {k: np.array([0, 1, 5, 100], t) for k, t in kinds.items()}
    values["BF16"] = (np.array([1.5, -2.0], "<f4").view("<u4") >> 16).astype("<u2")
    path = write(tmp_path / "x.safetensors", values, kind={k: k for k in values})
    found = {k: v for k, (_, _, v) in gathered(tensors.read_slices(spark, path, size=3)).items()}
    assert found.pop("BF16") == [1.5, -2.0] and all(v == [0, 1, 5, 100] for v in found.values())


def test_broken_files(spark, tmp_path, some):
    with pytest.raises(FileNotFoundError):
        tensors.read_slices(spark, str(tmp_path / "no"))
    write(tmp_path / "x.safetensors", some, kind="Q7")
    with pytest.raises(Exception, match="isn't supported"):
        tensors.read_slices(spark, str(tmp_path / "x.safetensors")).count()
    whole = open(write(tmp_path / "y.safetensors", some), "rb").read()
    (tmp_path / "y.safetensors").write_bytes(whole[:-20])
    with pytest.raises(Exception, match="ends inside"):
        tensors.read_slices(spark, str(tmp_path / "y.safetensors")).count()


def test_digests(spark, tmp_path, some):
    x, y = write(tmp_path / "x.safetensors", some), write(tmp_path / "y.safetensors", some, ["one", "none", "a", "b"])
    want = hashlib.sha256(b"".join(n.encode() + some[n].tobytes() for n in sorted(some))).hexdigest()
    assert tensors.streamed_digest(x, 10) == tensors.streamed_digest(y) == readers.weights_digest(x) == want
    lines = "\n".join(n + "\n" + hashlib.sha256(hashlib.sha256(some[n].tobytes()).hexdigest().encode()).hexdigest() for n in sorted(some))
    assert tensors.tree_digest(spark, x) == tensors.tree_digest(spark, y) == hashlib.sha256(lines.encode()).hexdigest()
    assert tensors.tree_digest(spark, write(tmp_path / "z.safetensors", some | {"one": np.array(2.0, "<f4")})) != tensors.tree_digest(spark, x)
    with pytest.raises(ValueError, match="no tensors"):
        tensors.tree_digest(spark, write(tmp_path / "n.safetensors", {}))


def test_summary_and_folder(spark, tmp_path):
    odd = np.array([np.nan, np.inf, 0, 3], "<f4")
    folder = tmp_path / "all"
    folder.mkdir()
    write(folder / "p0.safetensors", {"x": odd, "y": np.array([3, 4], "<f4")})
    write(folder / "p1.safetensors", {"y": np.array([12.0], "<f4")})
    (folder / "note.txt").write_text("no tensors")
    got = {r.tensor: tuple(r)[1:] for r in tensors.tensor_summary(tensors.read_slices(spark, str(folder))).collect()}
    assert got["y"] == (3, 3, 3, 13.0) and got["x"][:3] == (4, 2, 3) and np.isnan(got["x"][3])


def test_written_tensors_come_back(spark, tmp_path):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 4.5]), ("b", [5.0]), (None, [0.5])]
    df = spark.createDataFrame(rows, "n string, v array<double>").repartition(2).withColumn("file", F.lit(1))
    tensors.write_tensors(df, str(tmp_path / "out"), "n", "v")
    found = sorted((r.tensor, r["values"]) for r in tensors.read_slices(spark, str(tmp_path / "out"), size=100).collect())
    assert sorted(x for _, v in found for x in v) == [0.5, 1.0, 2.0, 3.0, 4.5, 5.0]
    tensors.write_tensors(df.limit(0), str(tmp_path / "none"), "n", "v")
    assert tensors.read_slices(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        tensors.write_tensors(spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "n string, v array<double>").coalesce(1), str(tmp_path / "bad"), "n", "v")


def test_adapter_through_slices(spark, tmp_path):
    a, b = np.arange(6, dtype="<f4").reshape(2, 3), np.arange(8, dtype="<f4").reshape(4, 2)
    path = write(tmp_path / "x.safetensors", {"q.lora_A.weight": a, "q.lora_B.weight": b, "other": a})
    got = {(r.path, r.which): r.matrix for r in readers.read_adapter(spark, path).collect()}
    assert got == {("q", "A"): a.tolist(), ("q", "B"): b.tolist()}
