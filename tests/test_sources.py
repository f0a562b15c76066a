import hashlib
import json
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiteloom.sources import readers, sinks
from kiteloom.sources.shared import settled, shared_dir
from kiteloom.streaming import store


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return path


def test_delimited(spark, tmp_path):
    path = write(tmp_path / "a.tsv", '﻿id\ttext\tmore\n1\tNA\t\n\n2\t"a ""b""\tc\nd"\tx\n3\tshort\n')
    rows = readers.read_delimited(spark, path, {"id": "record_id"}, encoding="utf-8-sig").orderBy("raw_row_number").collect()
    assert [(r.record_id, r.text, r.more, r.raw_row_number) for r in rows] == [("1", "NA", "", 2), ("2", 'a "b"\tc\nd', "x", 3), ("3", "short", "", 4)]


def test_many_files_number_on(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for k in range(3):
        write(folder / f"p{k}.tsv", "id\n" + "".join(f"{k}-{i}\n" for i in range(4)))
    numbers = [r.raw_row_number for r in readers.read_delimited(spark, folder).collect()]
    assert sorted(numbers) == list(range(2, 14))


def test_missing_files_and_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_delimited(spark, tmp_path / "none.tsv")
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        readers.read_delimited(spark, tmp_path / "empty")
    path = write(tmp_path / "b.tsv", "wrong\n1\n")
    with pytest.raises(ValueError, match="missing.*group_id.*available.*wrong"):
        readers.read_prepared(spark, path)


def test_key_assertions(spark):
    df = spark.createDataFrame([(2, "a", "g"), (3, " ", "g"), (4, "b", " "), (5, "a", "g"), (6, "b", "g"), (7, None, "g")], "raw_row_number int, record_id string, group_id string")
    with pytest.raises(ValueError, match="'record_id': 2, 'group_id': 1"):
        readers.require_keys(df, "record_id", "group_id")
    with pytest.raises(ValueError, match=r"4 rows share a record_id; first: \['a', 'b'\]"):
        readers.require_unique(df, "record_id")
    readers.require_unique(df.where("raw_row_number IN (2, 4)"), "record_id")
    with pytest.raises(ValueError):
        readers.require_rows(df.where("false"))


def test_store_reads_what_is_whole(spark, tmp_path):
    path = tmp_path / "predictions_base.jsonl"
    assert readers.read_store(spark, path).count() == 0
    lines = ['{"record_id": 1, "prediction": "a"}', '{"record_id": "2", "prediction": null}', '["array"]', '{"record_id": "x"}', "", '{"record_id": "1", "prediction": "b"}', '{"record_id": "9", "pred']
    write(path, "\n".join(lines))
    read = lambda: {r.record_id: r.prediction for r in readers.read_store(spark, path).collect()}
    assert read() == {"1": "b", "2": None}
    sinks.append_store(path, [{"record_id": "3", "prediction": "é"}])
    assert read() == {"1": "b", "2": None, "3": "é"}
    sinks.append_store(tmp_path / "predictions_tuned.jsonl", [{"record_id": "1", "prediction": "z"}])
    assert readers.store_systems(tmp_path) == ["base", "tuned"]
    assert readers.read_stores(spark, tmp_path).groupBy("system").count().count() == 2
    with pytest.raises(FileNotFoundError):
        readers.store_systems(tmp_path / "none")


def test_streamed_store(spark, tmp_path):
    folder = tmp_path / "stream"
    sinks.append_parts(spark.createDataFrame([("1", "a"), ("2", "b")], "record_id string, prediction string").coalesce(1), folder)
    store.follow(store.read_lines(spark, folder), "latest_predictions", tmp_path / "cp").awaitTermination(60)
    assert {r.record_id: r.prediction for r in spark.table("latest_predictions").collect()} == {"1": "a", "2": "b"}


def test_documents(tmp_path):
    path = tmp_path / "x.json"
    assert readers.read_json(path, lenient=True) == {}
    sinks.write_json({"b": "é", "a": path}, path)
    assert "é" in path.read_text("utf-8") and list(readers.read_json(path)) == ["b", "a"]
    write(path, "[1]")
    with pytest.raises(ValueError):
        readers.read_json(path)


def test_frozen_files_and_digests(spark, tmp_path):
    df = spark.createDataFrame([(3, "g", "c", None), (1, "g", 'a "x"', "t"), (2, "g", "b\nb", "t")], "record_id int, group_id string, source string, target string").repartition(3)
    path = tmp_path / "test.tsv"
    digest = sinks.write_frozen(df, path, ["record_id"])
    raw = path.read_bytes()
    assert digest == hashlib.sha256(raw).hexdigest() and b"\r" not in raw and raw.startswith(b"record_id\t")
    assert sinks.write_sidecar(path, tmp_path / "side") == digest and (tmp_path / "side").read_text() == f"{digest}  test.tsv\n"
    rows, found = readers.read_verified(spark, path, tmp_path / "side")
    assert found == digest and [r.source for r in rows.orderBy("raw_row_number").collect()] == ['a "x"', "b\nb", "c"]
    write(path, "changed")
    with pytest.raises(ValueError):
        readers.read_verified(spark, path, tmp_path / "side")


def test_a_failed_write_leaves_the_old_file(tmp_path):
    path = write(tmp_path / "f", "old")
    with pytest.raises(RuntimeError):
        with sinks.replaced(path) as file:
            file.write("new")
            raise RuntimeError
    assert path.read_text() == "old" and len(list(tmp_path.iterdir())) == 1


def test_results_and_tables(spark, tmp_path):
    path = write(tmp_path / "r.csv", "record_id,chrfpp_base,source\n1,12.5,NA\n2,x,y\n")
    rows = readers.read_results(spark, path, ["chrfpp_base"]).orderBy("record_id").collect()
    assert [(r.chrfpp_base, r.source) for r in rows] == [(12.5, "NA"), (None, "y")]
    sinks.write_table(spark.range(3).withColumn("split", F.lit("a")), tmp_path / "t", ["split"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_tensors(spark, tmp_path):
    arrays = {"m.q.lora_A.weight": np.arange(6, dtype="<f4").reshape(2, 3), "m.q.lora_B.weight": np.ones((4, 2), "<f2"), "m.other": np.zeros(2, "<i8")}
    names = {"<f4": "F32", "<f2": "F16", "<i8": "I64"}
    header, data = {"__metadata__": {"a": "b"}}, b""
    for k, v in arrays.items():
        header[k] = {"dtype": names[v.dtype.str], "shape": list(v.shape), "data_offsets": [len(data), len(data) + v.nbytes]}
        data += v.tobytes()
    head = json.dumps(header).encode()
    path = tmp_path / "adapter_model.safetensors"
    path.write_bytes(struct.pack("<Q", len(head)) + head + data)
    found = readers.read_tensors(path)
    assert found.keys() == arrays.keys() and all((found[k] == arrays[k]).all() for k in arrays)
    assert sorted((r.path, r.which) for r in readers.read_adapter(spark, path).collect()) == [("m.q", "A"), ("m.q", "B")]


def test_checkpoint_scan(tmp_path):
    for name in ("checkpoint-25", "checkpoint-100", "checkpoint-x", "other"):
        (tmp_path / name).mkdir()
    assert [s for s, _ in readers.scan_checkpoints(tmp_path)] == [100, 25]
    assert readers.scan_checkpoints(tmp_path / "none") == []


def test_pages():
    page = sinks.html_page({"x": "</script><b>"}, "t")
    assert "</script><b>" not in page and "<\\/script>" in page
    card = sinks.model_card({"systems": {"base": {"chrfpp": 1.0, "bleu": 2.0, "exact_copy_rate": 0.5}}, "sentences": 3, "significance": {"tuned": {"observed_delta": 1, "ci95_low": 0.5, "ci95_high": 2, "p_value": 0.01}}}, "T", "a", "b")
    assert "| base | 1.00 | 2.00 | 50.0% |" in card and "+1.00" in card


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert settled(spark.range(5), "x").count() == 5


def test_no_private_folder_off_one_machine(spark, monkeypatch):
    from types import SimpleNamespace

    from kiteloom.sources import shared

    nothing = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(getConf=lambda: nothing, master="spark://there:7077", applicationId="app"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(cluster)
    cluster.sparkContext.master = "local[2]"
    assert Path(shared.shared_dir(cluster)).is_dir()


def test_settled_tables_are_marked_for_deletion(spark):
    from kiteloom.sources import shared

    path = shared.written(spark.range(3).toDF("x"), "three")
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [0, 1, 2]
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert place.getFileSystem(spark._jsc.hadoopConfiguration()).cancelDeleteOnExit(place)
