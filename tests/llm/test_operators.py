"""Each operator against brute force or an exact round trip, and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmend.llm import exact_dedup, media, packing, pretokens, quality, queries, sentencepieces, sharding, simhash, token_counts, token_matrix, toxicity

WORD, BYTE, PIECE = (pretokens.tokenizer_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD_TEXTS = ["", " ", "a  b\n\n c\t", "it's 'STOP' ''s -'s it''ll", "ÀÉÎ ²½ ª µ\xa0x\x85y", "\x1c\x1d x", "<|endoftext|>a <|startoftext|>", "naïve Œuvre İI", "x" * 500, "日本語 テスト", "'Re 'RE 's", "ß ẞ", "a\x00b", "  '  's", "\r\n  \r\n x", "12 345", "▁▁ a▁b", "<s> x </s>"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_library(path, texts):
    from tokenizers import Tokenizer

    ours, library = pretokens.Encoder(path), Tokenizer.from_file(path)
    all_texts = [*ODD_TEXTS, *texts.values()]
    for text, ids in zip(all_texts, ours.encode(all_texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_with_a_full_cache(monkeypatch, texts):
    monkeypatch.setattr(pretokens, "CACHE_ENTRIES", 50)
    ours = pretokens.Encoder(WORD)
    some = list(texts.values())[:40]
    assert [b for t in some for b in ours.encode([t])] == pretokens.Encoder(WORD).encode(some)


UNUSUAL = ["aB1 .\n'sté", "日本語テスト かな、。１２", "Σσς ΑΒΓ αβγ'", "אבג ١٢٣ ", "áë \u3000 x", "😀🎉 👩‍👩‍👧 a", "<|endoftext|> a\n", "İIıßẞǅ a1", "Აა 𝒜𝟙 \u200b\ufeff", "²Ⅷ①½ x"]


def unusual_texts(n):
    rng = random.Random(3)
    for _ in range(n):
        letters = rng.choice(UNUSUAL) + rng.choice(UNUSUAL)
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(30))) + rng.choice(["", "", "<|endoftext|>", "<|startoftext|>x"])
        ranges = [(32, 127), (0x80, 0x3000), (0x3000, 0xD800), (0xE000, 0x110000)]
        yield "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(12)))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_over_all_of_unicode(path):
    """Any script takes the table and cache, special strings too, and gives the library's ids."""
    from tokenizers import Tokenizer

    ours, library = pretokens.Encoder(path), Tokenizer.from_file(path)
    some = list(unusual_texts(1500))
    for text, ids in zip(some, ours.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(ours.split(t) is None for t in some) <= 0.02 * len(some) and ours.split("日本語 テスト <|endoftext|>") is not None
    if path == BYTE:
        counts = token_counts.TokenCounter(BYTE, token_counts.LengthTable({})).counts(some)
        assert counts == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


def test_disputed_code_points_go_to_the_library():
    members = {"L": list("ab"), "N": list("12"), "S": [" "], "O": list("!?\n")}
    library = pretokens.encoder(BYTE).library.pre_tokenizer
    offsets = lambda t: [o for _, o in library.pre_tokenize_str(t)]
    assert pretokens.disputed(offsets, members, True) == ""
    wrong = {"L": list("a1"), "N": list("2b"), "S": [" ", "?"], "O": list("!c")}
    assert pretokens.disputed(offsets, wrong, True) == "1?bc"


# 1


def test_quality_separates_repetition(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["river", "stone", "bread", "light", "house"]) + rng.choice(["s", "y", "er"]) for _ in range(60)) for _ in range(80)]
    bad = [" ".join([w] * 20) for w in ("zig", "moo", "river", "house") for _ in range(10)] + ["%%% ### a$$$ b!!! " * 9] * 20
    examples = [quality.counted(t) for t in good + bad]
    model = quality.train(examples, [1] * len(good) + [0] * len(bad))
    score = lambda t: model.score(model.margin(t))
    assert score("stones lighty houser bready rivers " * 5) >= quality.THRESHOLD > score("frog frog frog frog frog frog frog frog")
    assert quality.train(examples, [1] * len(examples)).score(0.0) == pytest.approx(0.5)


def test_quality_counts_features_of_chunks_alike(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000))
    whole = Counter(np.concatenate(list(quality.buckets(text))).tolist())
    monkeypatch.setattr(quality, "CHUNK", 1 << 10)
    assert Counter(np.concatenate(list(quality.buckets(text))).tolist()) == whole


def test_quality_held_out(docs, labels):
    out = quality.scores(docs, quality.fit(docs, labels)).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) and ((held.score >= 0.7).astype(int) == held.predicted).all()
    assert (held.predicted == held.quality).mean() >= 0.85
    assert set(out[out.held_out].doc_id) == {i for i in out.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}


# 2


def test_exact_dedup(docs, texts):
    best = {}
    for i, t in texts.items():
        best[t] = max(i, best.get(t, -1))
    size = Counter(texts.values())
    for r in exact_dedup.exact_groups(docs).collect():
        t = texts[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best[t], size[t], best[t] == r["doc_id"], hashlib.sha256(t.encode()).hexdigest())
    assert {r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect()} == set(best.values())


def test_exact_dedup_with_a_full_filter(docs):
    small = exact_dedup.exact_groups(docs, max_bits=exact_dedup.SEGMENT_BITS)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))


def test_exact_dedup_in_slices(docs):
    """Several filters of a part of the hashes each, as tables beyond one filter take."""
    assert exact_dedup.filter_slices(10**9) == 12 and exact_dedup.filter_slices(1000) == 1
    assert sorted(map(tuple, exact_dedup.exact_groups(docs, slices=3).collect())) == sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))
    assert {r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs, slices=3).collect()} == {r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect()}


def test_filter_never_misses_a_repetition():
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(2**63), 2**63, 5000)
    bits = exact_dedup.SEGMENT_BITS
    pieces = [exact_dedup._pieces(bits)] * 2
    import pyarrow as pa

    both = [hashes[:3000], np.append(hashes[2900:], hashes[:5])]
    made = [b for p, h in zip(pieces, both) for b in p([pa.RecordBatch.from_arrays([pa.array(h)], ["h"])])]
    packed = np.zeros(bits // 8, np.uint8)
    import zlib as z

    for batch in exact_dedup._merged(made, 1):
        for s, b in zip(*(c.to_pylist() for c in batch.columns)):
            packed[s * exact_dedup.SEGMENT_BITS // 8 :][: exact_dedup.SEGMENT_BITS // 8] = np.frombuffer(z.decompress(b), np.uint8)
    found = exact_dedup.in_filter(packed, hashes, bits)
    assert found[2900:3000].all() and found[:5].all() and found.mean() < 0.1


# 3


def test_pieces_parity_and_round_trip(docs, texts):
    assert sentencepieces.parity([*ODD_TEXTS, *list(texts.values())[:120]], PIECE) == []
    rows = sentencepieces.encode_pieces(docs, PIECE)
    assert rows.filter("not same_text").count() == 0
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode_pieces(rows, PIECE).collect()}
    assert back == texts


def test_pieces_parity_around_markers():
    """Markers in the text itself, next to spaces and apart."""
    rng = random.Random(7)
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for letters in ("▁ a", "▁ ab\n", "▁  日x", "▁a b<s>\t") for _ in range(2500)]
    assert sentencepieces.parity(some, PIECE) == []
    assert sentencepieces.parity([a + b for a in ODD_TEXTS for b in ODD_TEXTS], PIECE) == []


def test_user_defined_pieces_are_refused():
    model = sentencepieces.Model(pieces=[("<unk>", 0.0, 2), ("▁", -1.0, 1), ("xy", 0.0, 4)], kind=sentencepieces.BPE)
    with pytest.raises(ValueError, match="user-defined"):
        model.tokenizer()


def test_unigram_model_is_rebuilt(tmp_path):
    """A small unigram model written by hand as protobuf."""
    import struct

    def piece(text, score, kind):
        body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3, 1), ("▁ab", -1, 1), ("a", -2, 1), ("b", -2, 1), ("ba", -2.5, 1)]
    data = b"".join(piece(*p) for p in pieces) + b"\x12\x02\x18\x01" + b"\x1a\x00"
    path = tmp_path / "u.model"
    path.write_bytes(data)
    assert sentencepieces.parity(["ab", "ab ab", "aba", "  a   b ", ""], str(path)) == []


# 4


def check_shards(spark, frame, shards=24, **how):
    rows = sharding.shard_digest(frame, shards=shards, **how).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(rows) == frame.count()
    return rows


def test_shards(spark, docs, texts):
    rows = check_shards(spark, docs)
    load = Counter()
    of = defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes")
        load[r["shard"]] += r["size"]
        of[t].add(r["shard"])
    assert len(load) == 24
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
    assert all(len(s) == 1 for s in of.values())


def test_a_hot_text_is_split(spark):
    frame = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    load = Counter()
    for r in check_shards(spark, frame, 8):
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 1.02 * min(load.values())


def test_large_units_are_numbered_in_parts(spark):
    """Windows bound what one task sorts; they change the order of slots, not the shards."""
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    keys = frame.select("doc_id", F.xxhash64("text").alias("key"), sharding.record_size().alias("size")).cache()
    plan = sharding.layout(keys, 4, ranges_per_shard=2, rows_per_window=50)
    assert max(v[2] for v in plan.units.values()) > 1
    few = check_shards(spark, frame, 4, ranges_per_shard=2, rows_per_window=50)
    whole = check_shards(spark, frame, 4, ranges_per_shard=2)
    assert {(r["doc_id"], r["shard"]) for r in few} == {(r["doc_id"], r["shard"]) for r in whole}


def test_hot_keys_are_counted_exactly(spark):
    """A key of tiny texts shows by its rows, one of long texts by its bytes; others are not taken for hot."""
    frame = spark.range(9000).select("id", F.when(F.col("id") < 3000, 1).when(F.col("id") < 3080, 2).otherwise(F.col("id")).alias("key"), F.when(F.col("id") < 3000, 8).when(F.col("id") < 3080, 90_000).otherwise(300).cast("bigint").alias("size"))
    plan = sharding.layout(frame.withColumnRenamed("id", "doc_id").cache(), 8)
    assert plan.hot == [1, 2]
    assert sum(n for _, n, _ in plan.units.values()) > 0 and all(r >= 0 for r, _ in plan.units)


def test_shards_against_sql(spark, sf_dir, tmp_path):
    """Sizes, gapless slots and equal texts together, in SQL over the result."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    sharding.shard_digest(spark.read.parquet(f"{sf_dir}/documents.parquet")).write.parquet(f"{tmp_path}/got")
    con.sql(f"CREATE VIEW got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    assert con.sql("SELECT count(*) FROM documents d FULL JOIN got g USING (doc_id) WHERE g.size IS DISTINCT FROM strlen(coalesce(d.text, '')) + 8").fetchall() == [(0,)]
    assert con.sql("SELECT count(*) FROM (SELECT shard FROM got GROUP BY shard HAVING min(slot) <> 0 OR max(slot) <> count(*) - 1 OR count(DISTINCT slot) <> count(*))").fetchall() == [(0,)]
    assert con.sql("SELECT max(n) FROM (SELECT count(DISTINCT shard) n FROM documents JOIN got USING (doc_id) GROUP BY coalesce(text, ''))").fetchall() == [(1,)]


def test_shards_keep_columns(spark, odd):
    out = sharding.shard_records(odd, shards=4)
    assert out.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"] and out.count() == odd.count()


def test_placing():
    rng = random.Random(3)
    units = [(rng.randrange(1, 100), i) for i in range(400)]
    load = Counter()
    for (s, _), shard in zip(units, sharding.place(units, 7)):
        load[shard] += s
    assert max(load.values()) - min(load.values()) <= 2
    where = sharding.place([(5, 1), (9, 1), (5, 2), (3, 3)], 2)
    assert where[0] == where[1]


# 5


@pytest.mark.parametrize("shape", [(5, 7, 3), (1, 1, 3), (16, 9, 3)])
def test_picture_round_trips(shape):
    pixels = np.random.default_rng(0).integers(0, 256, shape, np.uint8)
    assert (media.decode(media.encode_netpbm(pixels)) == pixels).all()
    assert (media.decode(media.encode_bmp(pixels)) == pixels).all()
    assert (media.decode(media.encode_netpbm(pixels[:, :, 0])) == pixels[:, :, 0]).all()


def test_plain_netpbm_and_palettes():
    assert media.decode(b"P2 # c\n2 2\n255\n0 1 2\n3").tolist() == [[0, 1], [2, 3]]
    assert media.decode(b"P1\n3 1\n101").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    head = b"BM" + np.array([70, 0, 62], "<u4").tobytes() + np.array([40, 2, 1, 1 | 1 << 16, 0, 4, 0, 0, 2, 0], "<u4").tobytes()
    assert media.decode(head + bytes([1, 2, 3, 0, 9, 8, 7, 0]) + b"\x40\x00\x00\x00").tolist() == [[[3, 2, 1], [7, 8, 9]]]


def test_area_resize_is_the_mean():
    pixels = np.arange(24.0).reshape(4, 6)
    assert np.allclose(media.area_resize(pixels, 2, 3), pixels.reshape(2, 2, 3, 2).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(pixels, 3, 4).mean(), pixels.mean())


def test_media_tiles(spark):
    good = media.encode_netpbm(np.random.default_rng(1).integers(0, 256, (40, 50, 3), np.uint8))
    rows = media.media_tiles(spark.createDataFrame([(1, good), (2, None), (3, b"P6\n9 9\n255\nx"), (4, b"GIF")], "id long, content binary"), "id", "content").collect()
    assert np.load(__import__("io").BytesIO(rows[0]["tile"])).shape == (32, 32, 3) and len(rows[0]["difference_hash"]) == 16
    assert all(r["tile"] is None and r["problem"] for r in rows[1:])


def test_resizing_in_strips_equals_the_whole(monkeypatch):
    pixels = np.random.default_rng(2).integers(0, 256, (157, 13, 3), np.uint8)
    whole = [media.area_resize(pixels, h, w) for h, w in ((32, 32), (8, 9), (200, 5))]
    monkeypatch.setattr(media, "STRIP", 10)
    assert all(np.allclose(a, media.area_resize(pixels, *a.shape[:2])) for a in whole)
    integral = np.pad(pixels.astype(float).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0), (0, 0)))
    want = np.diff(np.diff(integral[::157][:, ::13], axis=0), axis=1) / (157 * 13)
    assert np.allclose(media.area_resize(pixels, 1, 1), want)


def test_a_very_long_payload_needs_little_memory():
    import tracemalloc

    payload = media.to_payload("x" * 30_000_000)[0]
    pixels = media.decode(media.store_payload(payload))
    tracemalloc.start()
    assert media.npy_tile(pixels) and media.difference_hash(pixels) == "0" * 16
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_payload_features_come_from_the_stored_picture(docs, texts):
    """Both formats occur, and tile and hash are those of the picture in the file."""
    import io

    rows = media.payload_media(docs, with_media=True).limit(200).collect()
    assert {bytes(r["media"][:2]) for r in rows} == {b"BM", b"P6"}
    for r in rows:
        pixels = np.frombuffer(media.to_payload(texts[r["doc_id"]])[0], np.uint8).reshape(-1, 64, 3)
        assert (media.decode(r["media"]) == pixels).all() and hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"]
        tile = np.load(io.BytesIO(r["tile"]))
        integral = np.pad(pixels.astype(float).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0), (0, 0)))
        at = lambda values, n, axis: np.stack([np.take(values, int(e), axis) + (e - int(e)) * (np.take(values, min(int(e) + 1, values.shape[axis] - 1), axis) - np.take(values, int(e), axis)) for e in np.arange(n + 1) * ((values.shape[axis] - 1) / n)], axis)
        cells = np.diff(np.diff(at(at(integral, 32, 0), 32, 1), axis=0), axis=1) / ((len(pixels) / 32) * 2)
        assert np.abs(tile - cells).max() <= 0.5 + 1e-6
        assert r["feature"] == f"{media.difference_hash(pixels)}:{hashlib.sha256(r['tile']).hexdigest()[:16]}"


def test_payloads(docs, texts):
    for r in media.payload_media(docs).collect():
        raw = texts[r["doc_id"]].encode()
        want = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))


# 6 and 7


def check_pieces(rows, texts):
    library = pretokens.encoder(WORD).library
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    starts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        starts[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for group in (*starts.values(), *sequences.values()):
        end = 0
        for at, n in sorted(group):
            assert at == end
            end += n
    assert {i: sum(n for _, n in s) for i, s in starts.items()} == {i: len(x) for i, x in ids.items()}
    return [sum(n for _, n in s) for s in sequences.values()]


def test_packing(docs, texts):
    used = check_pieces(packing.pack(docs, WORD).collect(), texts)
    assert max(used) <= 4096 and sum(0 if u & (u - 1) == 0 else 4096 - u for u in used) <= 0.01 * sum(used)


def test_token_matrix(docs, texts):
    matrix = token_matrix.token_matrix(docs, WORD)
    used = check_pieces(token_matrix.pieces_of(matrix).collect(), texts)
    assert max(used) <= 4096
    for r in matrix.collect():
        assert len(r["ids"]) == 2 * 4096 and r["cu_seqlens"][-1] == sum(p["length"] for p in r["pieces"])
        for p, part in zip(r["pieces"], token_matrix.unpack_row(r["ids"], r["cu_seqlens"])):
            assert zlib.crc32(part.astype("<u4").tobytes()) == p["ids_crc32"]
        want = np.concatenate([np.arange(p["length"]) for p in r["pieces"]])
        assert np.array_equal(np.frombuffer(r["positions"], "<u2"), np.pad(want, (0, 4096 - len(want))))
    assert token_matrix.positions([0, 3, 5]).tolist() == [0, 1, 2, 0, 1]
    digests = {r["sequence_id"]: (zlib.crc32(r["ids"]), zlib.crc32(r["positions"]), zlib.crc32(",".join(map(str, r["cu_seqlens"])).encode()), len(r["pieces"])) for r in matrix.collect()}
    assert all((r["row_crc32"], r["positions_crc32"], r["cu_seqlens_crc32"], r["segments"]) == digests[r["sequence_id"]] for r in token_matrix.pieces_of(matrix).collect())


def test_ids_that_do_not_fit_raise():
    matrix = np.zeros((1, 4), "<u2")
    token_matrix.filled(matrix, 0, 1, np.array([65535], "<u4"))
    assert matrix[0].tolist() == [0, 65535, 0, 0]
    with pytest.raises(ValueError, match="70000"):
        token_matrix.filled(matrix, 0, 0, np.array([70000], "<u4"))


def test_packing_of_long_and_full_documents():
    """One document of many groups, pieces near the capacity, and many tiny ones: all lossless, with little padding."""
    rng = random.Random(5)
    for lengths in ([3_000_001], [rng.randrange(3900, 4096) for _ in range(400)], [rng.randrange(1, 30) for _ in range(20_000)]):
        packer = packing.Packer()
        for i, n in enumerate(lengths):
            packer.add(packing.Piece(i, 0, np.full(n, i % 7, "<u4"), n))
        packer.flush(last=True)
        got, used = Counter(), [sum(len(p.ids) for p in s) for s in packer.ready]
        for s in packer.ready:
            for p in s:
                got[p.doc_id] += len(p.ids)
        assert got == Counter(dict(enumerate(lengths))) and max(used) <= 4096
        assert sum(4096 - u for u in used if u & (u - 1)) <= 0.01 * sum(lengths)


def test_differencing():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 900) for _ in range(300)]
    where, sums = packing.difference(lengths, 20)
    assert sums.tolist() == [sum(n for n, w in zip(lengths, where) if w == k) for k in range(20)] and sums.max() - sums.min() <= 10
    where, windows = packing.windows_of([60] * 5, 3, 100)
    assert windows == 5  # two of them never fit together
    packer = packing.Packer(64, 500)
    for i in range(100):
        packer.add(packing.Piece(i, 0, np.arange(rng.randrange(1, 300), dtype="<u4"), 0))
    packer.flush(last=True)
    assert all(sum(len(p.ids) for p in s) <= 64 for s in packer.ready)


def test_best_fit_equals_brute_force():
    rng = random.Random(4)
    for _ in range(20):
        lengths = [rng.randrange(1, 65) for _ in range(50)]
        rooms, want = [], []
        for i in sorted(range(50), key=lambda i: (-lengths[i], i)):
            fit = [(r, b) for b, r in enumerate(rooms) if r >= lengths[i]]
            if not fit:
                rooms.append(64), want.append([])
                b = len(rooms) - 1
            else:
                b = min(fit)[1]
            rooms[b] -= lengths[i]
            want[b].append(i)
        got = token_matrix.best_fit(lengths, 64)
        assert len(got) == len(want) and sorted(i for b in got for i in b) == list(range(50)) and all(sum(lengths[i] for i in b) <= 64 for b in got)


# 8


def slow_fingerprint(text, n=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, radius):
    parent = {i: i for i in points}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(points)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (points[a] ^ points[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(docs, texts):
    fp = {i: slow_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fp, 2)
    for r in simhash.near_groups(docs).collect():
        assert (int(r["fingerprint"], 16), r["component_id"]) == (fp[r["doc_id"]], want[r["doc_id"]])


def near_points(rng, crowd):
    """Random fingerprints with chains of near ones, and many that share a segment's value."""
    points = [rng.getrandbits(64) for _ in range(40)]
    for p in points[:25]:
        q = p
        for _ in range(rng.randrange(1, 6)):  # chains of one to two flipped bits
            q ^= 1 << rng.randrange(64)
            q ^= rng.choice([0, 1 << rng.randrange(64)])
            points.append(q)
    low = rng.getrandbits(32)
    for _ in range(crowd):
        high = rng.getrandbits(11) << 40
        points += [high << 8 | low, (high << 8 ^ 1 << rng.randrange(32, 64)) | low ^ rng.choice([0, 1 << rng.randrange(32)])]
    return sorted({simhash.signed(p) for p in points})


@pytest.mark.parametrize("segments,crowd", [(2, 64), (2, 1), (3, 64), (4, 5), (8, 2)])
def test_links_are_all_pairs_within_the_radius(spark, segments, crowd):
    """Tables change with the number of segments and with what counts as crowded; links don't."""
    points = near_points(random.Random(8), 60)
    want = {(a, b) for k, a in enumerate(points) for b in points[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    frame = spark.createDataFrame([(p,) for p in points], "fp long")
    assert len(want) > 100 and {tuple(r) for r in simhash.links(frame, segments, crowd=crowd).collect()} == want


def test_segments_cover_all_bits():
    for n in (2, 3, 4, 8, 64):
        masks = simhash.segment_masks(n)
        assert sum(masks) == (1 << 64) - 1 and len(masks) == n
        assert len({flip for _, _, flip in simhash.segment_balls(n, 2)}) == (65 if n == 2 else 1)
    with pytest.raises(ValueError):
        simhash.segment_balls(1, 2)


@pytest.mark.parametrize("last_pairs", [0, 40, simhash.LAST_PAIRS])
def test_components_of_a_long_chain(spark, last_pairs):
    """By distributed rounds alone, by rounds and one last task, and by that task alone."""
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1000, 1050).select(F.lit(2000).cast("long").alias("a"), F.col("id").alias("b"))
    got = {r["node"]: r["root"] for r in simhash.components(chain.unionByName(star).repartition(7), last_pairs).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in (*range(1000, 1050), 2000)}}


def test_local_roots_and_forests():
    rng = np.random.default_rng(4)
    for n in (0, 1, 30, 400):
        a, b = rng.integers(0, 300, n), rng.integers(0, 300, n)
        root = {i: i for i in range(300)}
        for x, y in zip(a.tolist(), b.tolist()):
            low, high = sorted((root[x], root[y]))
            root = {k: low if v == high else v for k, v in root.items()}
        nodes, got = simhash.local_roots(a, b)
        assert dict(zip(nodes.tolist(), got.tolist())) == {i: root[i] for i in {*a.tolist(), *b.tolist()}}
        chosen = simhash.likeliest(a, b, rng.random(n))
        kept = simhash.local_roots(a[chosen], b[chosen])
        want = simhash.local_roots(*(x[a != b] for x in (a, b)))
        assert len(chosen) == len(want[0]) - len(set(want[1].tolist())) and all(np.array_equal(x, y) for x, y in zip(kept, want))


def test_similar_texts_are_grouped(spark):
    rng = random.Random(6)
    rows, near = [], {}
    for k in range(60):
        words = [f"{rng.choice('bcdfgh')}{rng.randrange(4000)}" for _ in range(400)]
        rows.append((10 * k, " ".join(words)))
        if k % 2:
            for i in range(0, 400, 80):
                words[i] = "changed"
            rows.append((10 * k + 1, " ".join(words)))
            near[10 * k + 1] = 10 * k
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in simhash.keep_one_of_each(frame).collect()}
    assert len(near.keys() & left) <= 1 and {10 * k for k in range(60)} <= left


def edited(rng, words, n, tag):
    """A copy of the words with n of them replaced, at places more than a shingle apart."""
    out = list(words)
    for at in rng.sample(range(0, len(words) - 5, 5), n):
        out[at + rng.randrange(5)] = f"{tag}{at}"
    return out


def alike(a, b):
    a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def grouped(spark, texts):
    frame = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame).collect()}
    return {i: found.get(i, i) for i in texts}


def brute_groups(texts, least=0.8):
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) > 0:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in texts}


def test_copies_meet_their_original_whatever_its_id(spark):
    """Edits near the original but not near each other: only the original links them."""
    rng = random.Random(11)
    texts = {}
    for k in range(6):
        words = [f"{rng.choice('bcdfgh')}{rng.randrange(4000)}" for _ in range(300)]
        texts[1000 * k + 37] = " ".join(words)
        for i in range(0, 74):
            if i != 37:
                texts[1000 * k + i] = " ".join(edited(rng, words, 6, f"e{i}x"))
    assert 0.8 <= alike(texts[37], texts[3]) and alike(texts[3], texts[4]) < 0.8
    got = grouped(spark, texts)
    assert got == {i: i - i % 1000 for i in texts} and got == brute_groups(texts)


def test_prefixes_of_similar_sets_meet():
    """No pair at the similarity is missed, whatever the number of rows and whichever shingles are listed as common."""
    rng = np.random.default_rng(12)
    for n in (*range(1, 40), 300, 2000):
        for _ in range(20):
            union = rng.choice(np.iinfo(np.int64).max, n, replace=False).astype(np.uint64) << np.uint64(1)
            side = rng.permutation(n)[: n - int(np.ceil(0.8 * n - 1e-9))]
            cut_at = rng.integers(len(side) + 1)
            a, b = (np.sort(np.delete(union, s)) for s in (side[:cut_at], side[cut_at:]))
            common = np.sort(rng.choice(union, rng.integers(n + 1), replace=False))
            assert set(simhash.set_prefix(a, 0.8, common).tolist()) & set(simhash.set_prefix(b, 0.8, common).tolist())
            sizes = [np.array([len(x)]) for x in (a, b)]
            most = simhash.most_apart(*sizes, 0.8)
            assert all(simhash.sketches_apart(x, y) <= most for x, y in ([simhash.node_sketch(s) for s in (a, b)], [simhash.odd_sketch(s, simhash.ENTRY_CELLS) for s in (a, b)]))


def test_odd_sketches_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(14)
    for n, m in ((0, 0), (0, 5), (200, 300), (300, 5000), (40_000, 40_000)):
        both = rng.choice(np.iinfo(np.int64).max, 30_000, replace=False).astype(np.uint64)
        a, b = (np.unique(rng.choice(both, k)) for k in (n, m))
        apart = simhash.sketches_apart(simhash.node_sketch(a), simhash.node_sketch(b))
        assert apart == simhash.sketches_apart(simhash.node_sketch(b), simhash.node_sketch(a)) <= len(np.setxor1d(a, b))
        folded = min(len(simhash.node_sketch(x)) for x in (a, b)) * 8
        assert apart == simhash.sketches_apart(simhash.odd_sketch(a, folded), simhash.odd_sketch(b, folded))


def test_groups_are_those_at_the_similarity(spark):
    """Pairs on both sides of 0.8 and at it, short texts too: as by brute force over the shingle sets."""
    rng = random.Random(13)
    texts, i = {}, 0
    for n in (6, 9, 13, 14, 24, 49, 50, 120, 300):
        for _ in range(12):
            words = [f"{rng.choice('bcdfgh')}{rng.randrange(4000)}" for _ in range(n)]
            texts[i] = " ".join(words)
            texts[i + 1] = " ".join(words[: n - rng.randrange(max(2, n // 4))])
            texts[i + 2] = " ".join(edited(rng, words, max(0, round(n / rng.uniform(35, 60))), "z"))
            i += 3
    values = [alike(texts[k], texts[k + d]) for k in range(0, i, 3) for d in (1, 2)]
    assert sum(0.8 <= v < 0.85 for v in values) > 10 and sum(0.7 <= v < 0.8 for v in values) > 10 and 0.8 in values
    assert grouped(spark, texts) == brute_groups(texts)


def test_proposals_do_not_grow_with_shared_shingles(spark, monkeypatch):
    """Long texts that share a passage, and copies that share most shingles: pairs are proposed for few of them."""
    rng = random.Random(15)
    passage = [f"p{k}" for k in range(200)]
    texts = {i: " ".join([f"u{i}x{k}" for k in range(1500)] + passage) for i in range(40)}
    for k in range(6):
        words = [f"{rng.choice('bcdfgh')}{rng.randrange(4000)}" for _ in range(300)]
        texts |= {100 + 10 * k + i: " ".join(edited(rng, words, 4, f"e{i}x")) for i in range(10)}
    made, proposals = {}, simhash.proposals

    def counted(forests, similarity):
        run = proposals(forests, similarity)
        rows = made.setdefault(forests, spark.sparkContext.accumulator(0))

        def each(batches):
            for batch in run(batches):
                rows.add(batch.num_rows)
                yield batch

        return each

    monkeypatch.setattr(simhash, "proposals", counted)
    assert grouped(spark, texts) == brute_groups(texts)
    assert made[True].value < len(texts) and made[False].value < len(texts)


@pytest.mark.parametrize("broadcast_rows", [0, simhash.BROADCAST_ROWS])
def test_buckets_in_parts(spark, monkeypatch, broadcast_rows):
    """Buckets of many parts, of one component and of several: as by brute force, whether tables are broadcast or not."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(16)
    words = [f"{rng.choice('bcdfgh')}{rng.randrange(4000)}" for _ in range(200)]
    texts = {i: " ".join(edited(rng, words, 2, f"a{i}x")) for i in range(40)}
    texts |= {100 + i: " ".join(edited(rng, words, 9, f"b{i}x")) for i in range(40)}
    texts |= {200 + i: " ".join(words[:120] + [f"c{i % 4}x{k}" for k in range(80)] + [f"d{i}"]) for i in range(40)}
    want = brute_groups(texts)
    assert len(set(want.values())) > 4 and grouped(spark, texts) == want


def test_bounds_of_entries_never_rule_out_the_similarity():
    """At the first shared shingle of similar sets places allow the pair, and sketches of any two lengths differ in no more cells than the sets."""
    rng = np.random.default_rng(17)
    sets = []
    for n in (1, 5, 40, 300, 700, 3000, 9000):
        for _ in range(20):
            union = np.sort(rng.choice(np.iinfo(np.int64).max, n, replace=False).astype(np.uint64) << np.uint64(1))
            side = rng.permutation(n)[: n - int(np.ceil(0.8 * n - 1e-9))]
            cut_at = rng.integers(len(side) + 1)
            a, b = (np.delete(union, s) for s in (side[:cut_at], side[cut_at:]))
            common = np.sort(rng.choice(union, rng.integers(n + 1), replace=False))
            heads = [simhash.set_prefix(s, 0.8, common).tolist() for s in (a, b)]
            first = next(h for h in heads[0] if h in set(heads[1]))
            sizes, places = ([np.array([x]) for x in side] for side in ((len(a), len(b)), [h.index(first) for h in heads]))
            assert simhash.may_start(sizes[0], places[0], sizes[1], places[1], 0.8).all()
            sets += [a, b]
    raw = [simhash.entry_sketch(s) for s in sets]
    left, right = (rng.integers(len(sets), size=500) for _ in range(2))
    sketches = simhash.Sketches(raw)
    for got in (sketches.coarse(left, right), sketches.fine(left, right)):
        assert all(x <= len(np.setxor1d(sets[i], sets[j])) for x, i, j in zip(got, left, right))
    assert sketches.fine(left, right).tolist() == [simhash.sketches_apart(raw[i], raw[j]) for i, j in zip(left, right)]


# 9


def test_counts(docs, texts):
    library = pretokens.encoder(BYTE).library
    for r in token_counts.token_counts(docs, BYTE).collect():
        t = texts[r["doc_id"]]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)


def test_counts_without_a_table():
    table = token_counts.LengthTable({})
    assert token_counts.TokenCounter(BYTE, table).counts(["a b", None, ""]) == [2, 0, 0]


# 10


def brute_vectors(texts, labels, association):
    """Full TF-IDF vectors from the raw texts, in plain dictionaries."""
    import math
    import re

    bags = [Counter(re.findall(r"[^\W\d_]+", t.lower())) for t in texts]
    n, n1 = len(bags), sum(labels)
    weight = {}
    for t in {t for b in bags for t in b}:
        d, a = sum(t in b for b in bags), sum(t in b and y for b, y in zip(bags, labels))
        phi = (n * a - d * n1) ** 2 / max(1, d * (n - d) * n1 * (n - n1)) if association else 1.0
        weight[t] = math.log(1 + n / d) * phi

    def vector(text):
        bag = Counter(re.findall(r"[^\W\d_]+", text.lower()))
        v = {t: (1 + math.log(c)) * weight[t] for t, c in bag.items() if weight.get(t)}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    return vector


@pytest.mark.parametrize("association", [False, True])
def test_nearest_equals_brute_force(association):
    """Every term counts, those seen once too; the nearest are those of the complete cosine from the raw texts."""
    rng = random.Random(9)
    names = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    texts = [" ".join([*rng.choices(names[:40] if i % 2 else names[20:], k=12), "own" + "abcdefghij"[i % 10] * (i // 10 + 1)]) for i in range(300)]
    labels = [i % 2 for i in range(300)]
    index = toxicity.Index.build(list(range(300)), [toxicity.term_counts(t) for t in texts], labels, association)
    vector = brute_vectors(texts, labels, association)
    examples = [vector(texts[i]) for i in index.ids]
    assert len(index.terms) == 360
    for text in [*texts[:40], "taa tab " * 3, "owna nothing else"]:
        q = vector(text)
        every = np.array([sum(x * e.get(t, 0) for t, x in q.items()) for e in examples])
        want = [w for w in np.lexsort((np.arange(300), -np.round(every, 12))) if every[w] > 0][: toxicity.NEIGHBOURS]
        places, cosines = index.nearest(index.vector(toxicity.term_counts(text)))
        assert places.tolist() == want and np.allclose(cosines, every[want])


def test_toxicity_of_whole_query_equals_brute_force(spark, docs, labels):
    """Scores from raw texts: complete cosines to all examples, votes and calibration by hand."""
    index = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    vector = brute_vectors([texts[i] for i in index.ids], index.toxic.tolist(), True)
    examples = [vector(texts[i]) for i in index.ids]
    for r in toxicity.scores(docs, index).limit(60).collect():
        q = vector(texts[r["doc_id"]])
        every = np.array([sum(x * e.get(t, 0) for t, x in q.items()) for e in examples])
        best = np.lexsort((np.arange(len(every)), -np.round(every, 12)))[: toxicity.NEIGHBOURS]
        weight = every[best] ** 2
        raw = (weight * index.toxic[best]).sum() / (weight.sum() + toxicity.NO_EVIDENCE)
        assert r["score"] == pytest.approx(index.score(raw), abs=1e-9)


def test_equal_examples_and_ids(spark):
    """Of equal texts the smallest id is the example; ids may repeat or be text."""
    rows = [("b", "you fool and clown"), ("a", "you fool and clown"), ("c", "a calm river"), ("c", "zz a calm river"), ("d", None)]
    marked = [("a", 1), ("b", 1), ("c", 0), ("d", 0), ("c", 0)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(i, y, y) for i, y in marked], "doc_id string, toxic int, quality int")
    index = toxicity.fit(docs, labels, out_of=1, held=-1)
    assert sorted(index.ids) == ["a", "c", "d"] and "zz" not in index.terms
    assert toxicity.scores(docs, index).count() == 5 and quality.scores(docs, quality.fit(docs, labels, out_of=1, held=-1)).count() == 5


def test_toxicity_held_out(docs, labels):
    out = toxicity.scores(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) and (held.predicted == held.toxic).mean() >= 0.85
    assert held[held.toxic == 0].predicted.mean() <= 0.1
    assert ((out.score >= 0.7).astype(int) == out.predicted).all() and out.score.between(0, 1).all()


# Odd tables


def label_rows(spark, column):
    return spark.createDataFrame([(i, i % 2, None if i == 3 else i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda d, l: quality.scores(d, quality.fit(d, l)),
    "exact": lambda d, l: exact_dedup.exact_groups(d),
    "pieces": lambda d, l: sentencepieces.encode_pieces(d, PIECE),
    "shards": lambda d, l: sharding.shard_digest(d),
    "media": lambda d, l: media.payload_media(d),
    "simhash": lambda d, l: simhash.near_groups(d),
    "counts": lambda d, l: token_counts.token_counts(d, BYTE),
    "toxicity": lambda d, l: toxicity.scores(d, toxicity.fit(d, l)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, odd, empty, name):
    labels = label_rows(spark, "quality")
    assert OPERATORS[name](odd, labels).count() == odd.count()
    assert OPERATORS[name](empty, labels).count() == 0
    assert OPERATORS[name](odd, labels.filter("false")).count() == odd.count()


def test_odd_packing(odd, empty):
    rows = packing.pack(odd, WORD).collect()
    assert sum(r["start"] == 0 for r in rows) == odd.count()
    assert packing.pack(empty, WORD).count() == 0 and token_matrix.token_matrix(empty, WORD).count() == 0
    assert token_matrix.pieces_of(token_matrix.token_matrix(odd, WORD)).filter("start = 0").count() == odd.count()


def test_odd_stages(spark, odd, empty):
    labels = label_rows(spark, "toxic")
    for step in (exact_dedup.drop_exact_duplicates, simhash.keep_one_of_each):
        assert step(odd).columns == odd.columns and step(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(odd).collect()
    assert Counter((r["text"] or "") for r in kept) == Counter({(r["text"] or "") for r in odd.select("text").collect()})
    assert quality.keep_good(empty, labels).count() == 0 and toxicity.keep_civil(odd, labels).columns == odd.columns


def test_odd_values(odd):
    rows = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(odd).collect()}
    blank = hashlib.sha256(b"").hexdigest()
    assert rows[1, blank]["keep_id"] == 2 and rows[None, blank]["kept"] is False and rows[2, blank]["group_size"] == 3
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.near_groups(odd).collect()}
    assert prints[1] == prints[2] == prints[7] == "0" * 16


def test_queries_are_named_by_number():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
