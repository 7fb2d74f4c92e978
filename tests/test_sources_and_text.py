"""Readers, the verdict parser, collection, and image features."""

import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsieve.functions import images
from foldsieve.functions.verdicts import parse_response
from foldsieve.sources import folders, matrices, tables
from foldsieve.streaming import collect

VECTORS = [
    (["a1.png", "b2.jpg"], "filename: a1.png judgment: O\nfilename: b2.jpg judgment: X", {"a1.png": "O", "b2.jpg": "X"}, None),
    (["a1.png"], "filename: [a1.png] judgment: [X]", {"a1.png": "X"}, None),
    (["a1.png"], "a1.png: X", {"a1.png": "X"}, None),
    (["a1.png"], "Filename: a1.png judgment: O", IndexError, {"a1.png": "O"}),
    (["a1.png"], "filename: a1.png Judgment: X", {"a1.png": "X"}, None),
    (["foo.png"], "filename: foo.png Judgment: X", {"foo.png": "O"}, {"foo.png": "X"}),
    (["a1.png"], "| a1.png | X |", {"a1.png": "X"}, None),
    (["foo.png"], "| foo.png | X |", {"foo.png": "O"}, {"foo.png": "X"}),
    (["a1.png"], "a1.png\nX", {"a1.png": "X"}, None),
    (["a1.png"], None, {}, None),
    (["a1.png"], "filename: zzz.png judgment: O", {"zzz.png": "O"}, {}),
    (["a1.png"], "filename: a1.png judgment: unknown", {"a1.png": "O"}, {}),
    (["1.png", "11.png"], "11.png\nX", {"1.png": "X"}, {"11.png": "X"}),
    (["a1.png"], ": O", {"a1.png": "O"}, {}),
    (["a1.png"], "filename: a1.png judgment: O\nfilename: a1.png judgment: X", {"a1.png": "X"}, None),
]


@pytest.mark.parametrize("files,text,compat,strict", VECTORS)
def test_parser(files, text, compat, strict):
    if compat is IndexError:
        with pytest.raises(IndexError):
            parse_response(text, files)
    else:
        assert {k: v[0] for k, v in parse_response(text, files).items()} == compat
    assert {k: v[0] for k, v in parse_response(text, files, "strict").items()} == (compat if strict is None else strict)


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_folder(spark, tmp_path):
    red = np.zeros((30, 40, 3), np.uint8)
    red[..., 0] = 200
    for sub, name in (("pos", "a.png"), ("neg", "b.PNG"), ("neg", "note.txt")):
        (tmp_path / sub).mkdir(exist_ok=True)
        (tmp_path / sub / name).write_bytes(png(red))
    files = folders.labelled_images(spark, {str(tmp_path / "pos"): 1, str(tmp_path / "neg"): 0})
    assert {(r.filename, r.label) for r in files.select("filename", "label").collect()} == {("a.png", 1), ("b.PNG", 0)}
    meta = folders.file_metadata(spark, str(tmp_path / "pos")).first()
    assert (meta.width, meta.height, meta.is_jpeg) == (40, 30, 0)
    found = images.extract(spark.read.format("image").load(str(tmp_path / "pos"))).first()
    assert len(found.features) == 2342 and found.error is None
    histogram = np.array(found.features[:512]).reshape(8, 8, 8)
    assert histogram[0, 0, 6] == pytest.approx(1, abs=1e-3)  # blue, green, red


def test_image_functions():
    flat = np.full((224, 224, 3), 128, np.uint8)
    assert np.abs(images.standardize(flat).astype(int) - 128).max() <= 1
    assert np.array_equal(images.resize(flat, 50, 70), np.full((50, 70, 3), 128))
    assert not images.canny(images.gray(flat)).any()
    step = flat.copy()
    step[:, 112:] = 250
    edges = images.canny(images.gray(step))
    assert edges[100].sum() in (1, 2) and edges[:, :100].sum() == 0
    assert images.hsv(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], np.uint8))[0].tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 9]]
    assert images.uniform_lbp(images.gray(flat)).sum() == pytest.approx(1)
    assert images.hog(images.gray(step)).shape == (1296,)
    assert len(images.phash(step)) == 16


def test_matrices(spark, tmp_path):
    matrices.register(spark)
    np.save(tmp_path / "m.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    rows = spark.read.format("foldsieve_npy").option("path", str(tmp_path / "m.npy")).option("rowsPerPartition", 3).load()
    assert [(r.row_idx, r.vec) for r in rows.orderBy("row_idx").collect()] == [(i, [3.0 * i, 3 * i + 1, 3 * i + 2]) for i in range(4)]
    np.savez(tmp_path / "m.npz", names=np.array(["a", "b"]), e=np.ones((2, 2)))
    names = spark.read.format("foldsieve_npy").option("path", str(tmp_path / "m.npz")).option("array", "names").load()
    assert [r.vec for r in names.orderBy("row_idx").collect()] == [["a"], ["b"]]


def test_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,phash\nx,00000000000000e1\n")
    assert tables.read_csv(spark, str(tmp_path / "s.csv")).first()["phash"] == "00000000000000e1"
    sheet = (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>gpt</t></is></c></row>'
        '<row><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>O</t></is></c></row></sheetData></worksheet>'
    )
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>filename</t></si><si><t>a.png</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "v.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", shared)
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    assert tuple(tables.read_xlsx(spark, str(tmp_path / "v.xlsx")).first()) == (0, "a.png", "O")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sink = str(tmp_path / "sink")
    assert tables.append_once(rows, sink, "k") == 2 and tables.append_once(rows, sink, "k") == 0


def test_collection_resumes(spark, tmp_path):
    import tests_support
    from pyspark import cloudpickle

    files = spark.createDataFrame([(i, f"a{i}.png", bytes(i)) for i in range(23)], "row_idx long, filename string, content binary")
    make = {"stub": tests_support.stub, "broken": tests_support.broken}
    cloudpickle.register_pickle_by_value(tests_support)
    found = collect.collect_verdicts(spark, files, make, str(tmp_path / "out"), wait=0)
    rows = {r.filename: (r.stub, r.broken) for r in found.collect()}
    assert len(rows) == 23 and rows["a3.png"] == ("O", "") and rows["a4.png"] == ("X", "")
    log = collect.batch_log(spark.read.parquet(str(tmp_path / "out/responses")))
    assert {r.calls for r in log.where("provider = 'stub'").collect()} == {1}
    assert {r.calls for r in log.where("provider = 'broken'").collect()} == {9}
    again = collect.collect_verdicts(spark, files, {"stub": tests_support.broken, "broken": tests_support.broken}, str(tmp_path / "out"), wait=0)
    assert again.where(F.col("stub") == "O").count() == 11


def test_inner_retry_returns_the_last_response():
    class Partial:
        def ask(self, prompt, files, pictures):
            return "filename: a.png judgment: O"

    response, calls, error = collect.ask_until_complete(Partial(), ["a.png", "b.png"], [b"", b""], wait=0)
    assert (response, calls, error) == ("filename: a.png judgment: O", 9, "")


def test_providers_build_their_requests(monkeypatch):
    from foldsieve.streaming import providers as P

    monkeypatch.setenv("SOME_KEY", "secret")
    sent = []
    answers = {
        P.ChatProvider: {"choices": [{"message": {"content": "yes"}}]},
        P.MessagesProvider: {"content": [{"type": "text", "text": "yes"}]},
        P.ContentsProvider: {"candidates": [{"content": {"parts": [{"text": "yes"}]}}]},
    }
    for kind, answer in answers.items():

        def transport(url, headers, body, answer=answer):
            sent.append((url, headers, body))
            return answer

        config = P.Config(kind.__name__, "http://models.example/x", "m", "SOME_KEY")
        assert kind(config, transport).ask("look", ["a.png", "b.jpg"], [b"1", b"2"]) == "yes"
    chat, messages, contents = (body for *_, body in sent)
    assert [m["role"] for m in chat["messages"]] == ["system", "user", "user"] and "data:image/jpeg;base64,MQ==" in str(chat)
    assert [p["source"]["media_type"] for p in messages["messages"][0]["content"][:2]] == ["image/png", "image/jpeg"] and messages["max_tokens"] == 1000
    assert contents["contents"][0]["parts"][0] == {"text": "look"} and len(contents["contents"][0]["parts"]) == 3
    assert all("secret" in str(headers) for _, headers, _ in sent)
    monkeypatch.delenv("SOME_KEY")
    with pytest.raises(RuntimeError):
        P.ChatProvider(P.Config("a", "http://models.example/x", "m", "SOME_KEY"), transport).ask("", [], [])


def test_encoders(spark):
    from foldsieve.operators import encoders

    rows = spark.createDataFrame([(i, f"word{i % 3} and more" if i else None) for i in range(70)], "id int, text string")
    found = {r.id: r.vec for r in encoders.with_vectors(rows, "text", lambda: encoders.HashedWords(16)).collect()}
    assert len(found) == 70 and found[0] == [0.0] * 16 and found[1] == found[4] != found[2] and all(len(v) == 16 for v in found.values())
    protos = encoders.prompt_prototypes(spark, {"s": {0: ["bad noise"], 1: ["good prose", "an article"]}}, {"b": lambda: encoders.HashedWords(16)})
    lengths = [sum(x * x for x in r.vec) for r in protos.collect()]
    assert len(lengths) == 2 and lengths == pytest.approx([1, 1])


def test_matrix_writer_and_archives(spark, tmp_path):
    matrices.register(spark)
    rows = spark.range(10).selectExpr("id AS row_idx", "array(CAST(id AS DOUBLE), 1D) AS vec").coalesce(1)
    for options in ({}, {"array": "e"}):
        path = str(tmp_path / f"m{len(options)}")
        rows.repartitionByRange(3, "row_idx").sortWithinPartitions("row_idx").write.format("foldsieve_npy").mode("append").options(path=path, **options).save()
        back = spark.read.format("foldsieve_npy").options(path=path, rowsPerPartition=2, **options).load()
        assert sorted(map(tuple, back.collect())) == [(i, [float(i), 1.0]) for i in range(10)]
    np.savez(tmp_path / "plain.npz", a=np.zeros((2, 2)), b=np.arange(12.0).reshape(6, 2))
    plain = spark.read.format("foldsieve_npy").options(path=str(tmp_path / "plain.npz"), array="b", rowsPerPartition=2).load()
    assert plain.rdd.getNumPartitions() == 3 and [r.vec[0] for r in plain.orderBy("row_idx").collect()] == [0, 2, 4, 6, 8, 10]


def test_neighbours_equal_brute_force(spark, monkeypatch):
    from foldsieve.operators import knn, simjoin

    monkeypatch.setattr(knn, "BLOCK", 40)
    monkeypatch.setattr(knn, "PART", 7)
    rng = np.random.default_rng(2)
    rows = [(i, int(h) - 2**63, i % 2, int(rng.integers(4)), i) for i, h in enumerate(rng.integers(0, 2**64, 60, dtype=np.uint64).repeat(3)[:170])]
    frame = spark.createDataFrame(rows, "id long, hash long, y int, fold int, row_idx long")
    found = {r.id: r.pred for r in knn.knn_predictions(frame).collect()}

    def dist(a, b):
        return ((a ^ b) & (2**64 - 1)).bit_count()

    for i, h, _, fold, _ in rows:
        near = sorted((dist(h, g), o, y) for _, g, y, f, o in rows if f != fold)[:3]
        assert found[i] == int(sum(y for *_, y in near) / 3 > 0.5)
    for most in (0, 9, 20):
        pairs = {(r.a, r.b, r.dist) for r in simjoin.hamming_pairs(frame, most).collect()}
        assert pairs == {(i, j, dist(g, h)) for i, g, *_ in rows for j, h, *_ in rows if i < j and dist(g, h) <= most}
