import random

import pytest

from kiteloom.llm import toxicity

from .test_toxicity import CLEAN

STEMS = toxicity.Model((("idiot", 1.0),), (("grummel", 3.0),), ("grummei bear",), (-2.0, 8.0, 4.0))


@pytest.mark.parametrize("word", ["grummelig", "Grummelig", "grumm3lig", "grümmelig", "gruммelig"])
def test_stems_match_folded_text(word):
    assert STEMS.features(f"some plain words {word} about trains")[1] == STEMS.features("some plain words grummelig about trains")[1] > 0


def test_stems_inside_exception_phrases_do_not_count():
    assert STEMS.features("a grummel bear about trains") == (0.0, 0.0)


def test_stems_are_learned_from_disguised_words():
    rng = random.Random(6)
    texts = [" ".join([*(rng.choice(CLEAN) for _ in range(40)), *(f"gr{rng.choice('uüυ')}mm{rng.choice('e3')}l" + rng.choice("abcdefgh") * 2 for _ in range(4 * (i % 2)))]) for i in range(60)]
    found = toxicity._stems(texts[1::2], texts[::2], 200, 20.0)
    assert any(toxicity.fold(s).startswith("grummei") or "grummei".startswith(toxicity.fold(s)) for s, _ in found)
