"""Long texts without spaces: equal to the library, and in time that grows with their length."""

import base64
import random
import time

import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from arcweave.llm import sentencepiece_codec
from arcweave.llm.queries import sentencepiece_model
from arcweave.llm.sentencepiece_codec import SentencePieceCodec

CODEC = SentencePieceCodec.from_file(sentencepiece_model())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_model())
_rng = random.Random(11)
N = 200_000
LONG = {
    "base64": base64.b64encode(_rng.randbytes(N * 3 // 4)).decode(),
    "letters": "".join(_rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(N)),
    "frequent letters": "".join(_rng.choice("etaoinshrdlu") for _ in range(N)),
    "cjk": "".join(chr(_rng.randrange(0x4E00, 0x9FFF)) for _ in range(N)),
    "one letter": "a" * N,
    "dashes": "-" * N,
    "minified": "".join(_rng.choice(["function(", "){return", "var", "=", "this.", "é", "中", ";", "0"]) for _ in range(N // 4)),
}


@pytest.mark.parametrize("name", LONG)
def test_long_unspaced_texts(name):
    CODEC._forget()
    began = time.perf_counter()
    ids, bounds = CODEC.encode_batch([LONG[name]])
    assert time.perf_counter() - began < 5
    assert ids.tolist() == LIBRARY.encode(LONG[name])
    assert CODEC.decode_batch(ids, bounds) == [LONG[name]]


def test_blocks_of_a_long_word_meet(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "_BLOCK_CHARS", 7)
    rng = random.Random(2)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "the", "aB3é中"):
        for _ in range(40):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(49, 200)))
            CODEC._forget()
            assert CODEC.encode_batch([text])[0].tolist() == LIBRARY.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeinrst▁ .é中😀\n0"), min_size=40, max_size=160))
def test_any_text(text):
    CODEC._forget()
    assert CODEC.encode_batch([text])[0].tolist() == LIBRARY.encode(text)
