import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from loomgraph.llm import pieces

MODEL = pieces._processor(public_tokenizers.path("piece_bpe_32k.model"))
JOINED = pieces.joints([MODEL.id_to_piece(i).replace(pieces.SPACE, " ") for i in range(MODEL.get_piece_size()) if not (MODEL.is_control(i) or MODEL.is_unknown(i) or MODEL.is_byte(i))])
TEXTS = ["the cat", None, "", "a cat  sat\n\n on", "▁▁x▁", "日本語 ", " ", "the the", "é" * 90, None]


@pytest.mark.parametrize("part", [1, 20, 60, 1 << 20])
def test_words_are_the_texts_in_parts_of_any_size(monkeypatch, part):
    monkeypatch.setattr(pieces, "PART", part)
    kinds, number, bounds = pieces.words_of(pa.array(TEXTS), JOINED)
    words = kinds.to_pylist()
    assert words == sorted(set(words), key=lambda w: w.encode())
    assert set(number.tolist()) == set(range(len(words)))
    read = ["".join(words[k] for k in number[a:b]) for a, b in zip(bounds, bounds[1:])]
    assert read == [" " + t.replace("▁", " ") if t else "" for t in TEXTS]
    assert pieces.words_of(pa.array([], pa.string()), JOINED)[2].tolist() == [0]


def test_a_block_holds_little_more_than_its_texts():
    rng = np.random.default_rng(1)
    words = np.array(["w" + "".join(rng.choice(list("abcdefgh"), 5)) for _ in range(5_000)])
    column = pa.array([" ".join(rng.choice(words, 400)) for _ in range(pieces.BLOCK // 2_800)])
    tracemalloc.start()
    try:
        pieces.words_of(column, JOINED)
        assert tracemalloc.get_traced_memory()[1] < 4 * column.nbytes
    finally:
        tracemalloc.stop()
