import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chainspark.llm import text as T
from tests.llm import plain

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té中x", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_lines_are_those_of_plain_python(texts):
    for chunk in T.chunks(pa.array(texts, pa.string())):
        starts, ends, bounds = chunk.words()
        l_start, l_end, l_bounds = chunk.lines()
        raw = chunk.data.tobytes()
        for d in range(chunk.n):
            own = texts[chunk.first_row + d] or ""
            assert [raw[a:b].decode() for a, b in zip(starts[bounds[d]:bounds[d + 1]], ends[bounds[d]:bounds[d + 1]])] == plain.words(own)
            at = slice(l_bounds[d], l_bounds[d + 1])
            assert [raw[a:b].decode() for a, b in zip(l_start[at], l_end[at])] == own.split("\n")


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_equal_shingle_sets_are_equal_hash_sets(texts, k):
    seen = {}
    for chunk in T.chunks(pa.array(texts, pa.string())):
        starts, ends, bounds = chunk.words()
        values, first = T.sorted_sets(*T.shingles(T.Ranges(T.LOWER[chunk.data]).hash(starts, ends), bounds, k))
        for d in range(chunk.n):
            want = plain.shingle_set(texts[chunk.first_row + d], k)
            got = tuple(values[first[d]:first[d + 1]].tolist())
            assert len(got) == len(want) and seen.setdefault(want, got) == got
    assert len(set(seen.values())) == len(seen)


def test_hash_of_a_word_does_not_depend_on_its_place():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    chunk = next(T.chunks(pa.array([" ".join(words)])))
    starts, ends, _ = chunk.words()
    h = T.Ranges(chunk.data).hash(starts, ends)
    by = {}
    for w, x in zip(words, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_chunks_hold_whole_documents(monkeypatch):
    monkeypatch.setattr(T, "CHUNK_BYTES", 10)
    column = pa.array(["a b", None, "c" * 40, "", "d"])
    got = [(c.first_row, c.n, c.data.tobytes()) for c in T.chunks(column)]
    assert sum(n for _, n, _ in got) == 5 and b"".join(x for _, _, x in got) == b"a b" + b"c" * 40 + b"d"
    assert list(T.chunks(column.slice(2, 1)))[0].data.tobytes() == b"c" * 40
    assert np.array_equal(T.group_sum(np.arange(4), np.array([0, 0, 3, 4])), [0, 3, 3])
