"""Tokenisers, packing and media against their libraries and round trips."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import bestfit_pack, media_audio, piece_codec

TEXTS = [None, "", " ", "  two  spaces ", "a\nb\n\nc", "é ß 🙂 日本 \x00x", "<s> </s> ▁ <|endoftext|>", "x" * 5000, " ".join(f"word{i % 97}" for i in range(9000)), "tab\tand nbsp   \n  x"]


def test_pieces_equal_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    c, r = piece_codec.codec(piece_codec.model_path()), random.Random(1)
    pieces = list(c.ids)
    made = ["".join(r.choice(pieces) for _ in range(r.randint(1, 6))) for _ in range(3000)]
    made += ["".join(r.choice("abcdetion \n▁é🙂0") for _ in range(r.randint(0, 40))) for _ in range(3000)] + [" " * k + "x" + " " * j for k in range(0, 50, 3) for j in (0, 1, 17, 33)]
    for t in [*TEXTS, *made]:
        t = t or ""
        ids = sp.encode(t, add_eos=True)
        assert c.encode(t) == ids
        assert c.decode(ids) == sp.decode(ids)


def test_piece_rows(spark, tmp_path):
    import hashlib

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in piece_codec.query(spark, str(tmp_path)).collect():
        ids = sp.encode(TEXTS[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))


def test_packing(spark, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bestfit_pack.tokenizer_path())
    texts = [*TEXTS, *("word " * (k * 13 % 900) for k in range(150)), "word " * 7]
    spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = bestfit_pack.query(spark, str(tmp_path)).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        cut = len(ids) % 2048 or 2048
        starts = [0, *range(cut, len(ids), 2048)]
        for k, s in enumerate(starts):
            e = [*starts, len(ids)][k + 1]
            want[i, k] = (s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))
    assert got == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= bestfit_pack.lower_bound(np.array([r.length for r in rows])) + 1


def test_exchange_rounds(spark, monkeypatch):
    monkeypatch.setattr(bestfit_pack, "PARTITION", 40)
    r = random.Random(3)
    rows = [(i, 0, 0, r.randint(300, 1100), i) for i in range(400)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").checkpoint()
    got = bestfit_pack.pack(pieces).collect()
    assert sorted(x.doc_id for x in got) == list(range(400))
    fill = {}
    for x in got:
        fill.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert all(sum(n for _, n in b) <= 2048 for b in fill.values())
    assert all(o == sum(n for p, n in sorted(b) if p < o) for b in fill.values() for o, _ in b)
    assert len(fill) <= 1.06 * bestfit_pack.lower_bound(np.array([x[3] for x in rows]))


def test_repeated_pieces(spark):
    """More equal rows than two partitions hold, and others: no sequence is overfull, and few are more than the bound."""
    same = spark.range(90_000).selectExpr("cast(7 as bigint) as doc_id", "0 as piece", "cast(0 as bigint) as start", "cast(700 as bigint) as length", "cast(1 as bigint) as ids_crc32")
    other = spark.range(30_000).selectExpr("id + 10 as doc_id", "0 as piece", "cast(0 as bigint) as start", "cast(1500 + id % 7 as bigint) as length", "id as ids_crc32")
    out = bestfit_pack.pack(same.unionByName(other).repartition(6).checkpoint()).cache()
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("starts"), F.count("*").alias("c"))
    assert out.count() == 120_000
    assert fill.where("n > 2048 or n <> end or starts <> c").count() == 0
    sequences, bound = bestfit_pack.certificate(out)
    assert sequences == fill.count() and bound <= sequences <= 1.001 * bound
    out.unpersist()


def test_lower_bound_is_one():
    import itertools

    r = random.Random(2)
    for _ in range(200):
        items = [r.randint(1, 12) for _ in range(r.randint(0, 7))]
        best = 0
        for best in range(len(items) + 1):
            if any(all(sum(x for x, b in zip(items, p, strict=True) if b == k) <= 12 for k in range(best)) for p in itertools.product(range(max(1, best)), repeat=len(items)) if best or not items):
                break
        assert bestfit_pack.lower_bound(np.array(items, np.int64), 12) <= best


@pytest.mark.parametrize("text", TEXTS)
def test_media_round_trip(text):
    payload, n = media_audio.payload_of(text)
    raw = (text or "").encode()
    assert n == len(raw) and len(payload) % 576 == 0 and payload[:n] == raw and set(payload[n:]) <= {255} and payload
    back, rate = media_audio.load(media_audio.store(payload))
    assert back == payload and rate == media_audio.RATE


def test_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000).astype(np.float32)
    y = media_audio.resample(x)
    assert len(y) == 12000 and np.abs(np.fft.rfft(y)).argmax() == 440
    assert abs(np.abs(y[1000:-1000]).max() - 1) < 0.05


def test_hysteresis():
    e = np.array([0, 0, 4, 2.6, 2.6, 2.0, 0, 4, 4, 0], np.float64)
    m = e.mean()
    assert media_audio.segments(e, high=3 / m, low=2.2 / m) == [(2, 5), (7, 9)]


def test_media_rows(spark, tmp_path):
    import hashlib
    import io
    import json
    import wave

    spark.createDataFrame([*enumerate(TEXTS), (50, TEXTS[4]), (None, "x")], "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("Tensor", F.lit(2)).write.parquet(str(tmp_path / "documents.parquet"))
    out = media_audio.query(spark, str(tmp_path))
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(TEXTS) + 2 and rows[50][1:] == rows[4][1:]
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-(-max(len(raw), 1) // 576) * 576 - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        file = io.BytesIO()
        with wave.open(file, "wb") as w:  # the standard library's writer makes the same file
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(16_000)
            w.writeframes(payload)
        assert (r.media_bytes, r.media_sha256) == (len(file.getvalue()), hashlib.sha256(file.getvalue()).hexdigest())
        assert len(r.slot_spans) == media_audio.SLOTS and all(0 <= a < b for a, b in [*r.slot_spans, *r.segments])
    assert json.loads(out.schema["tensor"].metadata["ARROW:extension:metadata"]) == {"shape": [media_audio.SLOTS, media_audio.MELS]}
    f = media_audio.audio_features(spark.read.parquet(str(tmp_path / "documents.parquet"))).toArrow()
    tensors = media_audio.fixed_shape(f.column("tensor").combine_chunks())
    assert tensors.type.shape == [media_audio.SLOTS, media_audio.MELS]
    made = dict(zip(f.column("doc_id").to_pylist(), tensors.to_numpy_ndarray(), strict=True))
    assert made[4].shape == (media_audio.SLOTS, media_audio.MELS) and made[4].ravel().tolist() == rows[4].tensor
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert media_audio.query(spark, str(tmp_path)).count() == 0


def test_ids_among_white_space_are_the_librarys():
    import random

    r, words = random.Random(11), bestfit_pack.WordIds(bestfit_pack.tokenizer_path())
    alphabets = [[" ", " ", "a"], [" ", "\n", "x", "\t"], [" ", " ", "　", " ", "\x85", "\x1f", "b", "7", "!", "'s", "中", "<|", "<|endoftext|>"]]
    texts = ["", " ", "   ", "a  b", "a   b", "a  ", "a \n b", " a"] + ["".join(r.choices(r.choice(alphabets), k=r.randint(0, 30))) for _ in range(3000)]
    for _ in range(2):  # the second time from memory
        got = [np.frombuffer(b, "<u4").tolist() for b in words.ids(texts)]
        assert got == [e.ids for e in words.lib.encode_batch(texts, add_special_tokens=False)]
