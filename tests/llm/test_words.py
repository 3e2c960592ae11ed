import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from axisloom.llm import words

TEXT = st.text(alphabet=st.sampled_from(list("abAB  \t\n\r\x0b\x0cé日\x1c\x85\xa0")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_equal_the_pattern(texts):
    data, off = words.utf8(pa.array(texts, pa.string()))
    s, e, h, row = words.words(data, off)
    got = [[] for _ in texts]
    for a, b, r in zip(s, e, row):
        got[r].append(data[a:b].tobytes().decode())
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    flat = [w for g in got for w in g]
    assert len(set(h.tolist())) == len(set(flat))


def test_long_rows_hash_alike_in_parts():
    text = " ".join(f"word{i % 50}" for i in range(5000))
    a, b = (words.words(*words.utf8(pa.array([text])), limit=n)[2] for n in (1 << 22, 300))
    assert (a == b).all()


def test_pieces_cover_all_rows():
    arr = pa.array(["x" * n for n in (5, 1, 100, 2, 2)] + [None])
    parts = list(words.pieces(arr, 8))
    assert [lo for lo, _ in parts] == [0, 2, 3] and sum(len(p) for _, p in parts) == 6
