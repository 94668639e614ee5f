"""Long texts: hashes put together from parts, and what a worker of the decontamination holds."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from arcweave.llm import text
from arcweave.llm.decontaminate import _MATCH_TYPE, ItemIndex, _match_rows
from arcweave.llm.text import Words


def words_of(texts):
    data = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def test_hashes_do_not_depend_on_where_the_text_is_cut(monkeypatch):
    rng = random.Random(8)
    texts = ["", " ".join("".join(rng.choices("aBé", k=rng.randrange(1, 30))) for _ in range(200)), "x" * 500, " \n ", "x" * 499 + "y z", "Z"]
    words = words_of(texts)
    for lower in (True, False):
        whole = words.hashes(lower)
        for size in (1, 7, 64, 501):
            monkeypatch.setattr(text, "CHUNK_BYTES", size)
            assert np.array_equal(words.hashes(lower), whole)
            monkeypatch.undo()


def test_a_worker_holds_few_bytes_for_each_byte_of_a_long_text():
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(30))) for i in range(20)]
    filler = " ".join(f"v{rng.randrange(20_000)}" for _ in range(200_000))
    cut = text.CHUNK_BYTES - 100  # the item goes across the end of the first part
    long = " ".join([filler[:cut], items[3][1], *[filler] * 5, items[5][1]])
    index = ItemIndex(items, 5, 19)
    row = pa.StructArray.from_arrays([pa.array([1]), pa.array([long])], ["doc_id", "text"])
    batch = pa.RecordBatch.from_arrays([row, pa.array([long]), pa.array([[]], _MATCH_TYPE)], ["row", "text", "matches"])
    tracemalloc.start()
    (out,) = _match_rows(SimpleNamespace(value=index), 5, 0.8)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(m["item_id"], m["start_word"]) for m in out["matches"][0].as_py()] == [(3, len(filler[:cut].split())), (5, len(long.split()) - 30)]
    assert peak < 20 * len(long)
    # The text itself stays: only the rows and what was found come back.
    assert out.schema.names == ["row", "matches"]
