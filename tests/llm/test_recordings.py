import numpy as np
import pyarrow as pa

from loomgraph.llm import arrays, audio, toxicity


def song(rng, n=40):
    t = np.arange(1024) / audio.RATE
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in rng.integers(0, 24, n)])


def test_shifted_and_noisy_recordings_are_one(spark):
    rng = np.random.default_rng(1)
    a, b = song(rng), song(rng)
    sounds = [(1, a), (2, a[512 * 8 :]), (3, a + rng.normal(0, 0.005, len(a))), (4, b), (5, a), (6, a[:500]), (None, b[: 512 * 60])]
    rows = [(i, (x * 20000).astype("<i2").tobytes(), "x") for i, x in sounds] + [(7, None, "x"), (8, b"", "x"), (9, b"abc", "x")]
    media = spark.createDataFrame(rows, "id long, pcm binary, codes string")
    prints = audio.fingerprints(media, "id", "pcm")
    found = {r.id: r.class_id for r in audio.recordings(prints, "id").collect()}
    assert found == {1: 1, 2: 1, 3: 1, 5: 1, 4: 4, 6: 6, None: 4, 7: 7, 8: 8, 9: 9}
    assert audio.recordings(prints.limit(0), "id").count() == 0


def test_query_matches_all_pairs(spark):
    rows = {r.vec_id: r for r in audio.op6_audio(spark, "/root/testdata/sf0.001").collect()}
    codes = {i: np.array(r.codes, np.uint32) for i, r in rows.items()}
    ids = sorted(codes)[:120]
    runs = {i: {tuple(c[k : k + audio.RUN].tolist()) for k in range(len(c) - audio.RUN + 1)} for i, c in codes.items()}
    for i in ids:
        for j in ids:
            if i < j and runs[i] & runs[j] and audio.same_recording(codes[i], codes[j]):
                assert rows[i].class_id == rows[j].class_id


def test_silence_aligns_without_all_pairs():
    z, y = np.zeros(20000, np.uint32), np.zeros(15000, np.uint32)
    z[5], y[2] = 7, 7
    assert audio.align(z, y) == (3, 0.0)


def test_word_codes_and_blocks():
    column = pa.array(["a b A  b\n", None, "", " x ", "é É " + "y" * 300 + " " + "y" * 299 + "z", " "])
    codes, bounds = arrays.word_codes(column)
    assert bounds.tolist() == [0, 4, 4, 4, 5, 9, 9] and codes[0] == codes[2] and codes[1] == codes[3] and len(set(codes.tolist())) == 7
    found = arrays.Lookup(np.unique(codes))
    assert (np.unique(codes)[found.find(codes)] == codes).all() and found.find(np.array([5], np.uint64))[0] == -1
    x, y = arrays.unpack(arrays.pack(codes, np.empty(0, np.int32)))
    assert (x == codes).all() and not len(y)


def test_toxicity_histories_sum_to_one():
    names, coded = toxicity._coded(["a b c a b scum x", "d e f scum a", "a b c", "d a b c"] * 30)
    model, _ = toxicity._fit(coded, np.array([1, 1, 0, 0] * 30), len(names), 3.0)
    n = model.unigram.shape[1]
    for v in range(n):
        assert np.allclose(model.probabilities(np.full(n, v), np.arange(n)).sum(1), 1)
