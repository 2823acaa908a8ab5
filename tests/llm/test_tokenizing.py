"""Words encoded apart give the library's own ids, special strings in any case among them."""

import numpy as np
import pytest

from graphloom.llm.tokenizing import load, path_of, word_ids


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "<|endoftext|>", "a<|EndOfText|>b", "foo.. <|STARTOFTEXT|>.", "It's DON'T.", "\u00dcber  na\u00efve\n1,000 x..", ""])
def test_words_apart(text):
    path = path_of("word_bpe_49k.json")
    words = word_ids(path)
    for _ in range(2):
        assert np.frombuffer(words.encode(text.encode()), f"<u{words.width}").tolist() == load(path).encode(text, add_special_tokens=False).ids


def test_small_cache_gives_the_same(monkeypatch):
    """Words lost from both generations, or found in the elder one, have the same ids."""
    from graphloom.llm import tokenizing

    monkeypatch.setattr(tokenizing, "MOST_CACHED", 3)
    path = path_of("word_bpe_49k.json")
    words = tokenizing.WordIds(path)
    text = "one two, Two three. four five two one six. one, ONE seven two"
    for _ in range(3):
        assert np.frombuffer(words.encode(text.encode()), f"<u{words.width}").tolist() == load(path).encode(text, add_special_tokens=False).ids
    assert len(words) <= 3 and len(words.elder) <= 3
    pieces = tokenizing.PieceLengths(path_of("byte_bpe_50k.json"), {"one": 1})
    assert [pieces.count(text) for _ in range(2)] == [len(load(path_of("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids)] * 2
