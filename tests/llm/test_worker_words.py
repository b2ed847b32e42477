"""What Python workers learn and keep."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aidsift.llm import tokens, worker

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_new_words_are_learnt_in_one_text(monkeypatch):
    encoder, whole, calls = tokens.Encoder(BYTE, "byte"), Tokenizer.from_file(BYTE), []
    ask = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: (calls.append(len(texts)), ask(texts))[1])
    text = "Zorglub's qwxé, 12ab--x don't İ.) ñandú ***  two one a　b    tab\tend\nline (a) é ​z \x1c"
    for t in [text, text[::-1], text + " newword", " ".join(f"u{i}v" for i in range(500))]:
        assert np.frombuffer(encoder.encode(t), dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    calls.clear()
    encoder.encode(" ".join(f"neu{i}wort," for i in range(500)))
    assert sum(calls) <= 2


def test_a_worker_keeps_one_thing():
    made = []

    def make(x):
        made.append(x)
        return [x]

    first = worker.kept(make, 1)
    assert worker.kept(make, 1) is first and worker.kept(make, 2) == [2]
    assert len(worker._held) == 1 and worker.kept(make, 1) is not first
    worker.release()
    assert not worker._held and made == [1, 2, 1]


def test_a_known_word_is_looked_up_once():
    """Nothing but the lookup itself is done for words that have been met; new ones are learnt by it."""
    encoder, whole = tokens.Encoder(BYTE, "byte"), Tokenizer.from_file(BYTE)
    marks = "one*** two$$$ three_ four<> five&%@ don't' six's\nseven## \neight\n nine"
    for t in [marks, marks, "İ.) " + marks, " " + marks.replace(" ", "\n") + " hard1 x" + marks + " hard1"]:
        assert np.frombuffer(encoder.encode(t), dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert not encoder.hard
    asked = []
    words, learn = encoder.spaced.recent, encoder.spaced.recent.learn
    words.learn = lambda w: (asked.append(w), learn(w))[1]
    encoder.encode("new one*** two$$$ zwei zwei hard1 hard2 hard2 one***")
    assert sorted(asked) == ["hard2", "zwei"]


def test_words_that_age_are_kept_and_tails_of_marks_need_no_whole_text(monkeypatch):
    encoder, whole = tokens.Encoder(BYTE, "byte", cache_words=8), Tokenizer.from_file(BYTE)
    for i in range(6):
        t = " ".join(["the", "a***", "b\nc", f"n{i}", "", "is", "Éa,", *(f"w{'abcdef'[j]}" for j in range(i + 1))])
        assert np.frombuffer(encoder.encode(t), dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert len(encoder.spaced.older) and len(encoder.spaced.recent)
    encoder, calls = tokens.Encoder(BYTE, "byte"), []
    encoder.encode("x a***")
    ask = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: (calls.append(texts), ask(texts))[1])
    encoder.encode("x other*** words*** elle***")
    assert not calls


def test_what_a_worker_drops_is_gone():
    import weakref

    held = weakref.ref(worker.kept(tokens.Encoder, BYTE, "byte"))
    worker.release()
    assert held() is None


def test_new_words_take_the_short_way(monkeypatch):
    """New words of ASCII letters, with or without a tail of marks, and lines without odd white space need no general step."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Some plain words, with tails; and (more) \"quoted\" ones...\nA new line here! the end?"
    enc, want = tokens.Encoder(path, "byte"), Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    for word in ("Some", "A", "\n", "\nA", "(more)", '"quoted"'):
        enc.bare.recent[word]
    general, asked = enc._plain, []
    monkeypatch.setattr(enc, "_plain", lambda word, known, before, mark: asked.append(word) if before else general(word, known, before, mark))
    assert np.frombuffer(enc.encode(text), dtype="<u4").tolist() == want
    assert asked == ["(more)", '"quoted"']


@pytest.mark.parametrize("space", ["   ", " \n ", "\t\t\t", "\xa0\xa0\xa0", "   ", "\x85\r\n", "\x1c\x1d\x1e"])
def test_long_white_space_is_not_cut(space):
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok = tokens.Encoder(path, "byte"), Tokenizer.from_file(path)
    for text in (f"a{space}b c", f"a b{space}", f"a b{space[:2]}", f"{space}a\nb", f"é{space}b\n"):
        assert np.frombuffer(enc.encode(text), dtype="<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
