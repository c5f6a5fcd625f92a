import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from galley import __main__ as cli
from galley import api
from galley.functions import pixels
from galley.operators import evidence, images, proposals, units
from galley.sources import materials


def test_commands_over_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.md").write_text("# t\n1．q\n【答案】\nA\n", encoding="utf-8")
    (tmp_path / "src/b.doc").write_bytes(b"x")
    found = {r.kind: r.error for r in api.run(spark, "convert", path=str(tmp_path / "src")).collect()}
    assert found["md"] is None and "unsupported" in found["doc"]
    (unit,) = api.run(spark, "import", path=str(tmp_path / "src")).collect()
    assert unit.content == "1．q\n【答案】\nA"
    (seen,) = api.run(spark, "inspect-source", path=str(tmp_path / "src")).where("chars > 0").collect()
    assert (seen.headings, seen.lines) == (1, 4)
    (tmp_path / "manifests/x").mkdir(parents=True)
    (tmp_path / "manifests/x/manifest.json").write_text(json.dumps({"schema_version": 1, "task_id": "t", "unit_ids": {"单元1": "u"}}), encoding="utf-8")
    (tmp_path / "manifests/manifest.json").write_text("{broken", encoding="utf-8")
    assert sorted(r.error or "" for r in units.manifests(spark, str(tmp_path / "manifests")).collect()) == ["", "invalid-manifest"]


def test_unknown_commands_and_arguments(spark, capsys):
    with pytest.raises(api.CommandError) as e:
        api.run(spark, "unit-reed")
    assert e.value.to_dict()["details"] == {"suggestion": "unit-read"}
    with pytest.raises(api.CommandError):
        api.run(spark, "calc", nothing="x")
    assert cli.main(["calc", "operation=evaluate", 'params={"expression": "2^10"}']) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["result"] == "1024"
    assert cli.main(["nothing"]) == api.EXIT["usage"] and json.loads(capsys.readouterr().out)["code"] == "usage"
    assert cli.main(["--help"]) == 0 and "unit-submit" in capsys.readouterr().out


def test_every_command_of_the_survey():
    assert len(api.COMMANDS) == 31


def test_doctor_sees_drift(spark):
    state = {r.name: r.state for r in api.doctor(spark, "0" * 64).collect()}
    assert state["proposal-schema"] == "drift"
    json.dumps(proposals.schema())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k long, text string, source string, start int, `end` int, id string")
    assert units.page(none, "k", "text").count() == 0
    assert evidence.occurrences(none, none, "k", "text").count() == 0
    assert materials.parsed(spark.createDataFrame([], "path string, content binary")).count() == 0


@pytest.mark.parametrize("data", [b"", b"\x89PNG\r\n\x1a\n", b"BM", b"\xff\xd8\xff", b"GIF89a", None])
def test_damaged_images(spark, data):
    assert spark.createDataFrame([(data,)], "d binary").select(images.summary(F.col("d")).alias("s")).first().s.format is None


def test_png_filters_and_colours():
    """All filters and kinds of colour against pixels that are known, and a round trip."""
    rng = np.random.default_rng(1)
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    for colour, n in ((0, 1), (2, 3), (3, 1), (4, 2), (6, 4)):
        want = rng.integers(0, 4 if colour == 3 else 256, (10, 7, n)).astype(np.uint8)
        lines, above = [], np.zeros(7 * n + n, np.int64)
        for y in range(10):
            row = np.concatenate([np.zeros(n, np.int64), want[y].ravel()])
            a, b, c = row[:-n], above[n:], above[:-n]
            paeth = [min((abs(q - r), 0, p), (abs(p - r), 1, q), (abs(p + q - 2 * r), 2, r))[2] for p, q, r in zip(a, b, c, strict=True)]
            guess = (np.zeros_like(a), a, b, (a + b) // 2, np.array(paeth))[y % 5]
            lines.append(bytes([y % 5]) + ((row[n:] - guess) % 256).astype(np.uint8).tobytes())
            above = row
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, colour, 0, 0, 0)) + chunk(b"PLTE", bytes(range(12))) + chunk(b"tRNS", bytes([9, 8]) if colour == 3 else bytes(2 * n)) * (colour in (0, 2, 3)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
        got = pixels.decode_png(data)
        if colour == 3:
            assert (got[..., :3] == np.arange(12).reshape(4, 3)[want[..., 0]]).all() and (got[..., 3] == np.array([9, 8, 255, 255])[want[..., 0]]).all()
        else:
            assert (got[..., :3] == (want[..., :3] if n > 2 else want[..., :1])).all()
            assert (got[..., 3] == (want[..., -1] if colour in (4, 6) else np.where((want == 0).all(2), 0, 255))).all()
        white = images.white_copy(data)
        assert (white is None) == bool((got[..., 3] == 255).all())
        assert white is None or images.header(white)[:3] == ("png", 7, 10) and (pixels.decode_png(white)[..., 3] == 255).all()
        assert pixels.decode_png(data[:-20]) is None and pixels.decode_png(data.replace(b"IDAT", b"IDAX")) is None


def test_images_of_files(spark, tmp_path):
    made = pixels.encode_png(np.zeros((2, 2, 3), np.uint8))
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    clear = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(5))) + chunk(b"IEND", b"")
    (tmp_path / "files/1").mkdir(parents=True)
    for name, data in (("shared.png", made), ("1/own.png", made), ("1/clear.png", clear), ("1/extra.png", made), ("1/broken.png", b"x"), ("1/done.png", clear)):
        (tmp_path / "files" / name).write_bytes(data)
    import hashlib

    (tmp_path / f"files/1/done.white-{hashlib.sha256(clear).hexdigest()[:16]}.png").write_bytes(images.white_copy(clear))
    spark.createDataFrame([(1, "![](shared.png) ![](own.png) ![](clear.png) ![](gone.png) ![](broken.png) ![](../up.png) ![](done.png)"), (2, "![](shared.png)")], "id long, text string").write.parquet(str(tmp_path / "texts"))
    found = api.run(spark, "inspect-images", texts=str(tmp_path / "texts"), folder=str(tmp_path / "files")).collect()
    assert sorted((r.id, r.path, r.code) for r in found) == [(1, "../up.png", "images.invalid_reference"), (1, "broken.png", "images.unreadable"), (1, "clear.png", "images.white_background_missing"), (1, "extra.png", "images.extra_images"), (1, "gone.png", "images.missing")]
    assert api.run(spark, "inspect-images", texts=str(tmp_path / "texts")).count() == 8


def test_submissions_are_committed(spark, tmp_path):
    from galley.sources import commits

    units_ = spark.createDataFrame([("t", 1, "r", "alpha beta", "i")], "task_id string, unit_id long, run_id string, source string, inputs_sha256 string")
    store = f"file://{tmp_path}/store"
    commits.begin(units_, store)
    seen = proposals.snapshots(commits.state(spark, store)).first().snapshot_sha256
    body = "alpha 【1|beta|B】"
    text = f"{proposals.HEAD}\n总结：轻微问题\n\n### 标记原文\n{proposals.LENGTH}{len(body)}:{len(body)} -->\n{body}\n{proposals.END}\n### 修改原因\n1. why\n"
    spark.createDataFrame([("t", 1, 1, seen, text)], "task_id string, unit_id long, seq int, expected_snapshot_sha256 string, text string").write.parquet(str(tmp_path / "subs"))
    assert api.run(spark, "unit-submit", submissions=str(tmp_path / "subs"), store=store).first().outcome == "accepted"
    now = api.run(spark, "unit-state", store=store)
    now.select("task_id", "unit_id", "run_id", "report_sha256").write.parquet(str(tmp_path / "reg"))
    assert api.run(spark, "unit-register", units=str(tmp_path / "reg"), store=store).first().outcome == "registered"
    assert api.run(spark, "unit-state", store=store).first().registered and not api.run(spark, "unit-state", store=store, version="1").first().registered
    with pytest.raises(api.CommandError):
        api.run(spark, "unit-submit", submissions="x")
