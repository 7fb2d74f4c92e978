"""Every operator against a brute-force version, on odd rows and on an empty table."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsieve.llm import bagminhash, html, media, mixing, quality, sentencepieces, sharding, shingles, suffixes, tokens

WORD = re.compile("[^\x20\x09-\x0d]+")


def jump(key: int, n: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(docs, texts, empty):
    rows = sharding.shard_documents(docs, 7).collect()
    assert len(rows) == len(texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((k, len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in texts)
    for r in rows:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 7), jump(r.doc_id or 0, 8))
        assert r.grown_shard in (r.shard, 7)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 64])
def test_jump_for_any_count(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567]
    rows = sharding.with_shards(spark.createDataFrame([(k,) for k in keys], "k long"), "k", n).collect()
    assert [(r.shard, r.grown_shard) for r in rows] == [(jump(k, n), jump(k, n + 1)) for k in keys]


def fill(sizes: dict, share=1.5, most=2, weights=(5, 2, 1)) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while True:
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] > most * sizes[s]}
        if not over:
            return target | level
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over


def brute_mix(rows, packet):
    """rows of (key, source, text) -> per row, taken words; and the stream of (finish, key, text, pass) that the budget admits."""
    sizes = [len(WORD.findall(t or "")) for _, _, t in rows]
    total = defaultdict(int)
    for (_, source, _), n in zip(rows, sizes):
        total[source] += n
    targets = fill(total)
    places = {s: i for i, s in enumerate(sorted(total, key=lambda s: (s is None, (s or "").encode())))}

    def turn(i):
        key, _, text = rows[i]
        digest = hashlib.md5((text or "").encode()).hexdigest()
        return hashlib.md5(f"mix:{'null' if key is None else key}:{digest}".encode()).hexdigest()

    stream, clock = [], defaultdict(int)
    for turn_no in (0, 1):
        for i in sorted(range(len(rows)), key=turn):
            source = rows[i][1]
            for at in range(0, sizes[i], packet or max(sizes[i], 1)):
                piece = min(packet or sizes[i], sizes[i] - at)
                if clock[source] < targets[source]:
                    stream.append(((clock[source] + piece) / targets[source], places[source], piece, i, turn_no))
                clock[source] += piece
    left, taken, admitted = int(1.5 * sum(sizes) + 0.5), [0] * len(rows), []
    for finish, _, piece, i, turn_no in sorted(stream):
        if left > 0:
            admitted.append((i, turn_no))
        taken[i] += min(piece, max(left, 0))
        left -= piece
    return sizes, targets, total, taken, admitted


def test_mixing(docs, texts, empty):
    rows = mixing.mix_sources(docs).collect()
    source = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    sizes, targets, total, taken, _ = brute_mix(source, mixing.PACKET)
    want = Counter((k, n, total[s], round(targets[s], 6), x) for (k, s, _), n, x in zip(source, sizes, taken))
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rows) == want
    by_source = defaultdict(int)
    for (_, s, _), x in zip(source, taken):
        by_source[s] += x
    assert all(abs(by_source[s] - targets[s]) <= mixing.PACKET for s in total) and sum(taken) == int(1.5 * sum(sizes) + 0.5)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sorted(map(str, mixing.mix_sources(docs.repartition(3)).collect())) == sorted(map(str, rows))
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_rows(empty).count() == 0


def test_mixed_rows_are_whole_documents(docs):
    rows = mixing.mixed_rows(docs).collect()
    assert set(docs.columns) == set(rows[0].asDict())
    source = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    sizes, *_, admitted = brute_mix(source, None)
    want = Counter(source[i] for i, _ in admitted) + Counter(row for row, n in zip(source, sizes) if not n)
    assert Counter((r.doc_id, r.source, r.text) for r in rows) == want
    longest, budget = max(sizes), 1.5 * sum(sizes)
    assert 0 <= sum(len(WORD.findall(r.text or "")) for r in rows) - budget < longest


def test_mix_of_tied_rows_agrees_between_runs(spark, prose):
    """Null keys, equal sizes, equal texts: every shuffling hands out the same rows."""
    rows = [(None, prose(5000 + i % 150, 60), f"s{i % 4}", i % 7) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, turn int")
    found = [sorted(map(str, mixing.mixed_rows(frame.repartition(n, F.rand(n))).collect())) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 400


def test_mixing_equals_its_sql(spark, docs, tmp_path):
    import duckdb

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    database = duckdb.connect()
    database.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = database.sql(mixing.MIX_SQL).fetchall()
    found = mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert Counter((*r[:3], round(r[3], 6), r[4]) for r in found) == Counter((*r[:3], round(r[3], 6), r[4]) for r in want)


def base(text: str) -> tuple:
    words = WORD.findall(text)
    counts = Counter(zip(words, words[1:], words[2:]))
    hit = {i + d for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for d in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(hit)


def test_quality(docs, texts, empty, spark, prose):
    rows = quality.quality_verdicts(docs).collect()
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert found == Counter((k, *base(t)) for k, t in texts)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in rows}
    symbols = [k for k, t in texts if t.count("###") > 50]
    assert len(symbols) == 4 and not any(kept[k] for k in symbols)
    plain = [k for k, t in texts if 100 <= len(t.split()) <= 130 and "#" not in t]
    assert all(kept[k] for k in plain)
    assert quality.quality_verdicts(empty).count() == 0 and quality.keep_good(empty).count() == 0
    good = quality.keep_good(docs)
    assert good.columns == docs.columns
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in rows if r.kept)


def test_repeat_words_with_many_doubled_windows(spark, prose):
    text = prose(5, 700) + " " + prose(5, 700) + " " + prose(6, 50)
    frame = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    assert quality.base_statistics(frame).first().n_repeat_words == base(text)[4] > 1300


def brute_estimates(rows):
    """The estimates in numpy: rows of (lang, source, four features) -> node -> (mean, covariance with floors, scale)."""
    groups = defaultdict(list)
    for lang, source, *x in rows:
        for node in ((), (lang,), (lang, source)):
            groups[node].append(x)
    groups = {node: np.array(x) for node, x in sorted(groups.items(), key=lambda g: len(g[0]))}
    floors = np.array(quality.FLOORS)

    def inside(bins, share):
        order = np.sort(bins)
        return bins <= order[np.ceil(share * len(order)).astype(int) - 1]

    def bins(distance):
        return np.floor(np.log(distance + 1e-9) * quality.DISTANCE_BINS)

    def shrunk(own):
        out = {}
        for node, value in own.items():
            n = len(groups[node])
            out[node] = value if not node else tuple((n * v + quality.PRIOR * u) / (n + quality.PRIOR) for v, u in zip(value, out[node[:-1]]))
        return out

    def distance(x, mean, cov):
        return np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(cov + np.diag(floors**2)), x - mean)

    def median(x):
        cell = np.floor(x * quality.VALUE_BINS)
        return (cell[inside(cell, 0.5)].max() + 0.5) / quality.VALUE_BINS

    now = {0: {}, 1: {}}
    for node, x in groups.items():
        middle = np.array([median(c) for c in x.T])
        scaled = np.abs(x - middle) / np.maximum(1.4826 * np.array([median(np.abs(c - m)) for c, m in zip(x.T, middle)]), floors)
        now[0][node], now[1][node] = (scaled**2).sum(1), scaled.max(1) ** 2
    for _ in range(quality.STEPS):
        params = {}
        for start, distances in now.items():
            own = {}
            for node, x in groups.items():
                x = x[inside(bins(distances[node]), quality.COVERED)]
                own[node] = x.mean(0), np.cov(x.T, bias=True)
            params[start] = shrunk(own)
            now[start] = {node: distance(x, *params[start][node]) for node, x in groups.items()}
    found, scales = {}, {}
    for node, x in groups.items():
        dets = [np.linalg.slogdet(params[s][node][1] + np.diag(floors**2))[1] for s in (0, 1)]
        found[node] = params[int(dets[1] < dets[0] - 1e-9)][node]
        cell = bins(distance(x, *found[node]))
        scales[node] = ((cell[inside(cell, 0.5)].max() + 0.5) / quality.DISTANCE_BINS - np.log(quality.CHI_MEDIAN),)
    scales = shrunk(scales)
    return {node: lambda x, node=node: distance(x, *found[node]) / np.exp(max(scales[node][0], 0)) for node in groups}


def test_kept_equals_brute_force(spark, prose, docs):
    rng = np.random.default_rng(8)
    rows = [(r.lang, r.source, r.text) for r in docs.where("text is not null").collect()]
    for i in range(400):  # a large, a middling and many tiny groups; other word lengths, repeats and symbols among them
        text = prose(1000 + i, 60 + i % 80, 40 + i)
        text = text.replace("w", "longer") if i % 23 == 0 else text + " #" * 20 if i % 29 == 0 else text + f"\n{text[:100]}\n{text[:100]}" if i % 7 == 0 else text
        rows.append((["en", "de", None][rng.integers(3) * (i % 3 == 0)], f"s{rng.integers(2) if i % 5 else i}", text))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    found = quality.judged(quality.base_statistics(frame)).collect()
    assert len(found) == len(rows)
    good = [r for r in found if not r.base_failed]
    judge = brute_estimates([(r.lang, r.source, *(r[x] for x in quality.FEATURES)) for r in good])
    rejected = 0
    for r in good:
        want = judge[r.lang, r.source](np.array([[r[x] for x in quality.FEATURES]]))[0]
        assert r.distance == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert r.kept == (want <= quality.CUT)
        rejected += not r.kept
    assert 10 < rejected < 100


@pytest.mark.parametrize("n", [30, 250])
def test_outliers_in_one_feature_alone(spark, prose, n):
    """At any size of a group: only repeated lines, only repeated windows, only symbols, only word lengths."""
    texts = [prose(2000 + i, 120) for i in range(n)]
    lines = [prose(9000 + j, 8) for j in range(12)]
    repeated = "\n".join([lines[0]] * 5 + lines[1:])
    windows = prose(9100, 60) + " " + " ".join([f"{prose(9200 + j, 5)} one two three" for j in range(12)])
    odd = [repeated, windows.replace("one two three", "one two three four"), prose(9300, 120).replace(" ", " # "), prose(9400, 120).replace("w", "muchlonger")]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(-1 - i, t, "en", "s") for i, t in enumerate(odd)]
    found = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(found[-1 - i].base_failed or found[-1 - i].kept for i in range(4))
    assert sum(found[i].kept for i in range(n)) >= 0.98 * n


def test_scatter_is_the_covered_covariance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal([1.6, 0.3, 0.2, 0.1], [0.2, 0.1, 0.3, 0.2], (400, 4))
    x[:40] += [3, 2, 1, 1]
    frame = spark.createDataFrame([("en", "s", *map(float, r)) for r in x], ["lang", "source", *quality.FEATURES])
    found = quality.estimates(frame).where("level = 2").first()
    mean = np.array([found[f"m{j}"] for j in range(4)])
    low = np.zeros((4, 4))
    for j in range(4):
        for k in range(j + 1):
            low[j, k] = found[f"l{j}{k}"]
    distance = ((np.linalg.solve(low, (x - mean).T)) ** 2).sum(0)
    assert distance[:40].min() > np.quantile(distance[40:], 0.99)  # the outliers do not mask themselves
    assert np.abs(mean - x[40:].mean(0)).max() < 0.06


def test_sentencepieces(docs, texts, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path(sentencepieces.MODEL))
    rows = sentencepieces.encode_documents(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(r.text or ""), r.text
    back = sentencepieces.decode_documents(sentencepieces.encode_documents(docs)).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)
    assert all(r.lossless for r in sentencepieces.encoding_digests(docs).collect())
    assert sentencepieces.encode_documents(empty).count() == 0


def test_token_counts(docs, texts, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCABULARY))
    want = Counter((k, len(t.encode()), n := len(library.encode(t, add_special_tokens=False)), n > 2048) for k, t in texts)
    assert Counter(map(tuple, tokens.token_counts(docs).collect())) == want
    assert tokens.token_counts(empty).count() == 0


def test_every_plain_character_is_encoded_as_by_the_library():
    path = tokens.vocabulary_path(tokens.VOCABULARY)
    encoder, counter = tokens.TextEncoder(path, False), tokens.TextEncoder(path, True)
    texts = [t for c in map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)]) for t in (f"a{c}b", f"{c}li {c}", f"SA{c}", f"1{c}{c.lower()}2")]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == want
    assert counter(texts) == [len(x) for x in want]


def test_every_character_of_the_basic_plane_is_encoded_as_by_the_library():
    encoder = tokens.TextEncoder(tokens.vocabulary_path(tokens.VOCABULARY), False)
    texts = [f"{c} a{c}b" for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder(texts) == want


def test_segments_cover_long_texts(prose):
    text = prose(8, 3000) + "\n" + "y" * 9000 + " end"
    parts = list(tokens.segments(text, 1000))
    assert "".join(parts) == text and len(parts) > 10


def test_token_files(docs, texts, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCABULARY))
    rows = sorted(tokens.token_file_digests(docs).collect(), key=lambda r: r.start)
    ids = {}
    for k, t in texts:
        ids.setdefault(k, []).append([*library.encode(t, add_special_tokens=False).ids, 2])
    at, last = 0, -1
    for r in rows:
        assert r.start == at and (r.doc_id if r.doc_id is not None else -1) >= last
        match = [x for x in ids[r.doc_id] if len(x) == r.n_tokens and zlib.crc32(np.asarray(x, "<u4").tobytes()) == r.ids_crc32]
        assert match
        ids[r.doc_id].remove(match[0])
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    assert not any(ids.values())
    assert tokens.token_file_digests(empty).count() == 0


def test_token_files_are_read_by_column(docs, spark, tmp_path):
    folder = f"file://{tmp_path}/ids"
    tokens.write_token_files(docs, folder)
    plan = spark.read.parquet(folder).select("n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<n_tokens:bigint>" in plan
    assert tokens.read_token_files(spark, folder).count() == docs.count()


def test_media(docs, texts, empty, spark):
    import io
    import wave

    pdf = "x" * 30 + "%PDF-1.4 some startxref 0 %%EOF and on"
    frame = docs.unionByName(spark.createDataFrame([(900, pdf, "en", "s", 1, "r")], docs.schema))
    rows = media.media_digests(frame).collect()
    want = Counter()
    for k, t in [*texts, (900, pdf)]:
        data = t.encode()
        data += b"\0" * (-len(data) % 64 if data else 64)
        file = io.BytesIO()
        with wave.open(file, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(data)
        stored = file.getvalue()
        inside = f"application/pdf@{44 + 30}+{pdf.index('%%EOF') + 5 - 30}" if k == 900 else "none"
        feature = f"audio/wav;corrected=true;samples={len(data)};mean={sum(data) / len(data) / 255:.6f};embedded={inside}"
        row = (k, len(t.encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
        want[row] += 1
    assert Counter(map(tuple, rows)) == want
    assert media.media_digests(empty).count() == 0


@pytest.mark.parametrize("magic", [b"%PDF-", b"PK\3\4", b"GIF89a0000000,", b"RIFF0000WAVE", b"BM", b"%PDF-startxref", b"PK\5\6"])
def test_carving_bytes_full_of_magic_numbers(magic):
    import time

    data = magic * (400_000 // len(magic))
    began = time.perf_counter()
    media.carve(data)
    assert time.perf_counter() - began < 5


def test_sniffing_rows_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, b"BM", "a/b", "old", [1])], "id int, media binary, declared string, type string, parts array<int>")
    found = media.sniff(rows)
    assert found.columns == ["id", "media", "declared", "type", "confirmed", "corrected", "parts"]
    assert found.first().type == "a/b" and found.first().parts == []
    assert media.sniff(rows.limit(0)).count() == 0


def test_carving_and_types(spark):
    import gzip
    import io
    import struct
    import zipfile

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(8) + b"\0" + b"\x02\x02\x44\x01\0" + b"\x3b"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xda" + struct.pack(">H", 4) + b"cd" + b"\x01\xff\x00\x02" + b"\xff\xd9"
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a", b"hello" * 50)
    parts = [png, gif, jpeg, gzip.compress(b"abc" * 500), box.getvalue(), media.wave(bytes(64)), b"%PDF-1.4\nx\nstartxref\n0\n%%EOF"]
    kinds = ["image/png", "image/gif", "image/jpeg", "application/gzip", "application/zip", "audio/wav", "application/pdf"]
    for data, kind in zip(parts, kinds):
        assert media.carve(data) == [(0, len(data), kind)]
        assert media.carve(data[:-3]) == []
    mixed = b"BM junk " + b"--".join(parts)
    found = media.carve(mixed)
    assert [k for _, _, k in found] == kinds and [mixed[o : o + n] for o, n, _ in found] == parts
    rows = spark.createDataFrame([(1, png, "image/jpeg"), (2, b"text", "text/plain"), (3, None, None), (4, mixed, "x")], "id int, media binary, declared string")
    out = {r.id: r for r in media.sniff(rows).collect()}
    assert (out[1].type, out[1].confirmed, out[1].corrected) == ("image/png", True, True)
    assert (out[2].type, out[2].confirmed, out[2].corrected) == ("text/plain", False, False)
    assert out[3].type is None and out[3].parts == []
    cut = media.cut_parts(media.sniff(rows)).where("id = 4").orderBy("offset").collect()
    assert [bytes(r.bytes) for r in cut] == parts


def test_bagminhash_is_unbiased(prose):
    import random

    rng, left, right = random.Random(4), [], []
    for i in range(60):
        words = prose(400 + i, 60, 30).split()
        other = list(words)
        for _ in range(rng.randrange(8)):
            other[rng.randrange(60)] = "zz"
        left.append(" ".join(words + words[:12] * (i % 4)).encode())
        right.append(" ".join(other + other[:12] * (i % 3)).encode())

    def bag(t):
        w = t.split()
        return Counter(zip(*(w[i:] for i in range(5))))

    want = np.array([sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values()) for a, b in zip(left, right)])
    assert np.abs(shingles.overlaps(left, right) - want).max() < 1e-12
    bags = shingles.Bags(left + right)
    assert np.abs(bags.similarities(np.arange(60), np.arange(60, 120)) - want).max() < 1e-12
    a, b = bagminhash.signatures(left, 2048)[0], bagminhash.signatures(right, 2048)[0]
    assert abs(((a == b).mean(1) - want).mean()) < 0.006
    assert np.abs((a == b).mean(1) - want).max() < 0.06
    again = np.concatenate([bagminhash.signatures([t], 2048)[0] for t in left])
    assert (a == again).all()  # a signature does not depend on the batch


def brute_classes(texts):
    bags = {}
    for i, (_, t) in enumerate(texts):
        w = WORD.findall(t)
        bags[i] = Counter(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        union = sum((bags[i] | bags[j]).values())
        if texts[i][1] == texts[j][1] or union and sum((bags[i] & bags[j]).values()) / union >= 0.8:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def partition(labels):
    groups = defaultdict(list)
    for member, label in labels:
        groups[label].append(member)
    return Counter(tuple(sorted(map(str, g))) for g in groups.values())


@pytest.mark.parametrize("small,block", [(16, 256), (1, 4)])
def test_near_duplicates(docs, texts, empty, small, block, monkeypatch):
    monkeypatch.setattr(bagminhash, "SMALL", small)
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    found = bagminhash.near_duplicates(docs).collect()
    want = partition((k, c) for (k, _), c in zip(texts, brute_classes(texts)))
    assert partition((r.doc_id, r.class_tk) for r in found) == want
    if small == 16:
        kept = bagminhash.keep_one(docs)
        assert kept.columns == docs.columns and kept.count() == len(found and {r.class_tk for r in found})
        assert bagminhash.near_duplicate_classes(empty).count() == 0 and bagminhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("small,block", [(16, 256), (1, 8)])
def test_family_of_near_copies(spark, prose, small, block, monkeypatch):
    """Many copies edited apart: some pairs above, some under the threshold; large and small buckets, in one block and many."""
    import random

    monkeypatch.setattr(bagminhash, "SMALL", small)
    monkeypatch.setattr(bagminhash, "BLOCK", block)

    rng, base_words, texts = random.Random(9), prose(50, 200).split(), []
    for i in range(90):
        words = list(base_words)
        for _ in range(rng.randrange(2, 8)):
            words[rng.randrange(200)] = f"e{i}x{rng.randrange(9)}"
        texts.append((i, " ".join(words)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    found = bagminhash.near_duplicates(frame).collect()
    assert partition((r.doc_id, r.class_tk) for r in found) == partition((k, c) for (k, _), c in zip(texts, brute_classes(texts)))


@pytest.mark.parametrize("small", [16, 1])
def test_near_copies_without_keys(spark, prose, small, monkeypatch):
    monkeypatch.setattr(bagminhash, "SMALL", small)
    one, two = prose(70, 200), prose(71, 200)
    texts = [(None, f"{one} {x}") for x in ("a", "b", "b", "c")] + [(None, f"{two} a"), (7, f"{two} b"), (None, prose(72, 200))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    rows = bagminhash.near_duplicate_classes(frame).collect()
    assert Counter((r.class_id, r.class_size, r.n_copies) for r in rows) == {(None, 4, 1): 2, (None, 4, 2): 2, (7, 2, 1): 2, (None, 1, 1): 1}
    assert bagminhash.keep_one(frame).count() == 3


def brute_removal(texts, length=200):
    counts = Counter()
    for _, t in texts:
        counts.update(t[i : i + length] for i in range(len(t) - length + 1))
    for key, t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        runs = sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1]))
        kept = bytes(b for b, c in zip(t, covered) if not c)
        yield key, len(t), sum(covered), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("block,family", [(1024, 8192), (2, 4), (1, 1)])
def test_suffix_removal(docs, texts, empty, block, family, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "FAMILY_ROWS", family)
    short = [(k, t.encode()) for k, t in texts if len(t) < 50000]
    frame = docs.where("text is null or length(text) < 50000")
    assert Counter(map(tuple, suffixes.removal_digests(frame).collect())) == Counter(brute_removal(short))
    if block == 1024:
        assert suffixes.removal_digests(docs).count() == len(texts)
        assert suffixes.removal_digests(empty).count() == 0
        assert suffixes.remove_repeats(empty).count() == 0 and suffixes.remove_repeats(empty).columns == docs.columns


@pytest.mark.parametrize("block", [256, 100000])
def test_removal_around_a_hot_passage(spark, prose, block, monkeypatch):
    """A passage in very many texts, cut off at either side in many ways; the same in one block and in many."""
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "FAMILY_ROWS", 2 * block)
    passage, rows = prose(600, 60)[:260], []
    for i in range(1500):
        begin, end = i % 61, 260 - i % 83
        rows.append((i, f"{prose(7000 + i, 12)} {passage[begin:end]} {prose(17000 + i, 12)}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(map(tuple, suffixes.removal_digests(frame).collect()))
    assert found == Counter(brute_removal([(k, t.encode()) for k, t in rows]))
    assert sum(n for (_, _, removed, *_), n in found.items() if removed) > 500


def test_family_hits_equal_counts():
    rng = np.random.default_rng(1)
    family, batches = suffixes.IndexFamily(), [rng.integers(0, 3000, 500).astype(np.uint64) for _ in range(12)]
    for keys in batches:
        family.add(keys)
    everything = np.concatenate(batches)
    counts = Counter(everything.tolist())
    assert family.hits().tolist() == [counts[k] > 1 for k in everything.tolist()]
    sizes = [len(level) for level, _ in family.levels]
    assert all(2 * b < a for a, b in zip(sizes, sizes[1:]))  # like-sized levels were merged


def test_long_texts_are_cut_into_segments(prose, monkeypatch):
    text = prose(7, 9000).encode()
    whole = suffixes.anchors([text, b"abc"])
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    parts = suffixes.anchors([text, b"abc"])
    for a, b in zip(whole, parts):
        assert np.array_equal(a, b)


def test_removed_texts_stay_whole_characters(spark):
    passage = "ünïcødé pässage " * 20
    frame = spark.createDataFrame([(1, "é" + passage + "a tail", "x"), (2, "è" + passage + "b tail", "y"), (3, passage, "z")], "doc_id long, text string, rid string")
    rows = {r.doc_id: r.text for r in suffixes.remove_repeats(frame).collect()}
    assert 3 not in rows and rows[1].endswith("a tail") and rows[1].startswith("é")


def test_html(spark):
    page = (
        '<html><head><title>T</title><script>var a="<p>";</script></head><body><header>top</header><nav><ul><li>menu</ul></nav>'
        '<div class="cookie-notice">cookies</div><article><h1>Head &amp; line</h1><p>one<br>two  three<!-- c --><p>f<b>ou</b>r&nbsp;five'
        '<form>no</form><aside>side</aside><ul><li>x<li>y</ul><section id="comments"><p>first!</section></article><footer>foot</footer></body></html>'
    )
    plain = "<body><div><p>shared notice of the site</p></div><div id=m{0}><p>own text {0}</p></div></body>"
    rows = [(1, "http://a.example/x", page, "z"), (2, None, None, "z"), (3, "http://a.example/y", "", "z")]
    rows += [(10 + i, f"https://U@B.example:80/{i}", plain.format("abcdefgh"[i]), "z") for i in range(8)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {r.page_id: r for r in html.extract_main_text(frame).collect()}
    assert found[1].text == "Head & line\none two three\nfour five\nx\ny" and found[1].n_chars == len(found[1].text)
    assert found[2].text == found[3].text == "" and found[2].n_chars == 0
    assert [found[10 + i].text for i in range(8)] == [f"own text {'abcdefgh'[i]}" for i in range(8)]
    assert html.extract_main_text(frame.limit(0)).count() == 0
    assert html.Page("<p>a<!-- open").main_text() == "a"
    assert html.Page("<nav>x<article><p>y").main_text() == "y"


@pytest.mark.parametrize("own", [1, 5])
def test_notice_that_shares_its_path_with_text(spark, own):
    want = ["\n".join(f"own text {i} {j}" for j in range(own)) for i in range(8)]
    bodies = ["".join(f"<p>{t}" for t in ["shared notice of the site", *w.split("\n")]) for w in want]
    rows = [(i, f"http://c.example/{i}", f"<body><div>{b}</div></body>") for i, b in enumerate(bodies)]
    found = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in sorted(found, key=lambda r: r.page_id)] == want


def test_style_tree_prunes_marked_articles(spark):
    def long(i):
        return f"own text {i} " * 9

    teaser = "<body><div><p>{0}</div><article><p>teaser {1}</p></article>"
    pages = {i: (f"http://d.example/{i}", f"<body><article><p>read more<p>{long(i)}</article>", long(i).strip()) for i in range(8)}
    pages |= {8 + i: (f"http://e.example/{i}", teaser.format(long(i), i), f"{long(i).strip()}\nteaser {i}") for i in range(8)}
    pages |= {16 + i: (f"http://f.example/{i}", teaser.format(long(i), "x"), long(i).strip()) for i in range(8)}
    pages |= {24 + i: (f"http://g.example/{i}", f"<body><article><p>{long(0)}</article>", long(0).strip()) for i in range(8)}
    rows = [(k, url, page) for k, (url, page, _) in pages.items()]
    found = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {k: want for k, (*_, want) in pages.items()}
    main = html.Page(f"<body><p>around<main><p>{long(1)}<article><p>card</article></main>")
    assert main.main_text() == f"{long(1).strip()}\ncard"


def test_style_tree_importance(spark):
    nodes = [("h", 1, 1, 7)] * 6 + [("h", 2, 1, i) for i in range(6)] + [("h", 3, 1, 9)] * 4 + [("h", 3, 1, i) for i in range(2)]
    frame = spark.createDataFrame(nodes, "host string, path long, kind int, value long")
    entries = {(e.path, e.value) for e in html.low_branches(frame).first().entries}
    assert (1, None) in entries and (1, 7) in entries and (3, 9) in entries and not {p for p, _ in entries} & {2}


def test_style_tree_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    nodes = []
    for host, pages in (("a", 40), ("b", 9), ("c", 3)):
        for page in range(pages):
            for path in range(8):
                if rng.random() < 0.8:
                    texts = {int(rng.integers(1 + 3 * path)) for _ in range(1 + path % 3)}
                    nodes += [(host, path, 2, 0), (host, path, 0, int(rng.integers(1 + path % 4)))] + [(host, path, 1, t) for t in texts]
    found = {r.host: {(e.path, e.value) for e in r.entries} for r in html.low_branches(spark.createDataFrame(nodes, "host string, path long, kind int, value long")).collect()}
    counts = defaultdict(Counter)
    for host, path, kind, value in nodes:
        counts[host, path, kind][value] += 1

    def entropy(c):
        total = sum(c.values())
        return -sum(n / total * np.log(n / total) for n in c.values()) / np.log(total) if total > 1 else 1.0

    want = defaultdict(set)
    for host, path in {(h, p) for h, p, _, _ in nodes}:
        shapes, words, pages = (counts[host, path, kind] for kind in (0, 1, 2))
        weight = html.DECAY ** len(shapes)
        if pages.total() >= html.LEAST_PAGES:
            if (1 - weight) * entropy(shapes) + weight * entropy(words) < html.LOW_IMPORTANCE:
                want[host].add((path, None))
            want[host] |= {(path, value) for value, n in words.items() if n > html.SHARE * pages.total()}
    assert found == {h: v for h, v in want.items() if v} and len(found) >= 2


def test_pipeline(spark, docs, empty, tmp_path):
    """Every stage's rows and texts, and the ids, against brute force; the quality verdicts have a test of their own."""
    import sentencepiece

    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(r.doc_id, r.text, r.source) for r in quality.keep_good(docs).collect()]
    first: dict = {}
    for (k, t, source), c in zip(kept, brute_classes([(k, t) for k, t, _ in kept])):
        digest = tuple(int.from_bytes(hashlib.sha256(t.encode()).digest()[i : i + 8], "big", signed=True) for i in (0, 8))
        mine = ((k is not None, k or 0, digest), k, t, source)
        first[c] = min(first.get(c, mine), mine, key=lambda x: x[0])
    one = [(k, t.encode(), source) for _, k, t, source in first.values()]
    starts = Counter(t[i : i + 200] for _, t, _ in one for i in range(len(t) - 199))
    left = []
    for k, t, source in one:
        covered = bytearray(len(t))
        for i in range(len(t) - 199):
            if starts[t[i : i + 200]] > 1:
                covered[i : i + 200] = b"\1" * 200
        text, at = t.decode(), 0
        out = ""
        for c in text:  # a character goes if all its bytes are covered
            size = len(c.encode())
            out += "" if all(covered[at : at + size]) else c
            at += size
        if out.split():
            left.append((k, source, out))
    assert len(left) < len(kept) < docs.count() and sum(len(t) for *_, t in left) < sum(len(t) for _, t, _ in one)
    *_, admitted = brute_mix(left, None)
    library = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path(sentencepieces.MODEL))
    want = Counter((left[i][0], left[i][1], left[i][2], tuple(library.encode(left[i][2]))) for i, _ in admitted)
    assert Counter((r.doc_id, r.source, r.text, tuple(r.ids)) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) and r.n_chars == len(r.text) for r in rows)


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    for n in range(1, 11):
        assert any(re.match(rf"op{n}_", name) for name in found), n
    assert "pipeline" in found and set(entry.oracle_sql()) <= set(found)
    assert F is not None
