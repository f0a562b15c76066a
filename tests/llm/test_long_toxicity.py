import random
import time

from kiteloom.llm import toxicity

PHRASES = tuple(toxicity.fold(p) for p in toxicity.EXCEPTIONS)
MODEL = toxicity.Model(tuple((toxicity.fold(w), x) for w, x in toxicity.SEED_WORDS.items()), (("scum", 1.5), ("idio", 2.0)), PHRASES, (-2.0, 1.0, 1.0))


def naive(text: str) -> tuple[float, float]:
    """Every place against every entry, every match against every exception phrase."""
    shown = toxicity.reveal(text)
    folded = toxicity.fold(shown)
    edge = lambda i: not (0 <= i < len(shown) and shown[i].isalnum())

    def places(entry: str, whole: bool):
        for i in range(len(folded) - len(entry) + 1):
            if folded[i : i + len(entry)] == entry and edge(i - 1) and (not whole or edge(i + len(entry))):
                yield i, i + len(entry)

    excepted = [p for phrase in MODEL.exceptions for p in places(phrase, True)]
    free = lambda p: not any(a <= p[0] and p[1] <= b for a, b in excepted)
    total = sum(w for entry, w in MODEL.words for p in places(entry, True) if free(p))
    stems = sum(w for entry, w in MODEL.stems for p in places(toxicity.fold(entry), False) if free(p))
    return total, 600 * (total + stems) / (60 + len(shown)) if shown else 0.0


def test_features_against_a_naive_matcher():
    rng = random.Random(6)
    parts = [*toxicity.SEED_WORDS, *toxicity.EXCEPTIONS, "1d10t", "ѕcum", "idiotic", "trash can trash", "class clown fish", "plain", "words", "é", "x" * 9]
    for _ in range(300):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        got, expected = MODEL.features(text), naive(text)
        assert max(abs(a - b) for a, b in zip(got, expected)) < 1e-9, text


def test_a_megabyte_of_matches_and_exceptions():
    for unit in ("idiot ", "trash can idiot ", "stupid simple "):
        began = time.monotonic()
        MODEL.features(unit * (1_000_000 // len(unit)))
        assert time.monotonic() - began < 10
