import random

import numpy as np
import pyarrow as pa

from tidelane.llm import textops


def test_words_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(1)
    texts = ["", None, "a", "x" * 300, " " * 100, *(" ".join("".join(rng.choice("abcDEé\n\t") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(0, 80))) for _ in range(40)), "y" * 200 + " z"]
    data, offsets = textops.utf8(pa.array(texts))
    for space in (textops._SPACE, textops.NOT_ALNUM):
        want = textops._words(data, offsets, space)
        for size in (1, 7, 64, 1000):
            monkeypatch.setattr(textops, "SLICE_BYTES", size)
            for a, b in ((0, len(texts)), (3, 4), (5, 30)):
                got = textops.words(data, offsets[a : b + 1], space)
                i, j = want[3][a], want[3][b]
                assert all(np.array_equal(x, y[i:j]) for x, y in zip(got[:3], want[:3], strict=True)) and np.array_equal(got[3], want[3][a : b + 1] - i)
        monkeypatch.undo()


def test_a_long_text_takes_little_memory_beside_its_words():
    import tracemalloc

    text = ("word " * 10 + "longer words\n") * 400_000
    data, offsets = textops.utf8(pa.array([text]))
    tracemalloc.start()
    hashes, *_ = textops.words(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes) == 4_800_000 and peak < 14 * len(text)
