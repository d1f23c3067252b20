import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from citesift.llm.texts import WordHashes, shingle_set, slices, windows, word_hashes

WORDS = st.text(alphabet="ab é\n\t\x1c\x85 .", max_size=80)


@given(WORDS)
def test_slices_keep_words_whole(text):
    data = text.encode()
    pieces = list(slices(data, 7))
    assert b"".join(pieces) == data
    assert [w for p in pieces for w in p.split()] == data.split()


@given(st.lists(st.sampled_from("abcd"), max_size=30))
def test_shingles_count_distinct_runs(words):
    hashes = word_hashes(" ".join(words).encode(), WordHashes())
    runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    expected = len(runs) if len(words) >= 5 else min(1, len(words))
    found = shingle_set(hashes)
    assert len(found) == expected
    assert (np.sort(found) == found).all()


def test_windows_of_equal_words_are_equal():
    hashes = word_hashes(b"a b c a b c", WordHashes())
    found = windows(hashes, 3)
    assert found[0] == found[3] and len(set(found.tolist())) == 3


def test_remembered_words_stay_bounded(monkeypatch):
    monkeypatch.setattr("citesift.llm.texts.KNOWN_WORDS", 3)
    known = WordHashes()
    text = b"a b c d e a b"
    assert (word_hashes(text, known) == word_hashes(text, WordHashes())).all()
    assert len(known) <= 3
