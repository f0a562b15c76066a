import random
import zlib

import pytest

from kiteloom.llm import queries, toxicity

from .conftest import by_id

CLEAN = "some plain words about weather and trains in the city today".split()


def made(toxic: bool, rng: random.Random, bad=("idiot", "scum", "moron")):
    words = [rng.choice(CLEAN) for _ in range(rng.randint(10, 60))]
    for _ in range(rng.randint(2, 4) if toxic else 0):
        words.insert(rng.randrange(len(words)), rng.choice(bad))
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    labels = [int(rng.random() < 0.3) for _ in range(400)]
    return toxicity.fit([made(y == 1, rng) for y in labels], labels)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op10_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows)
    caught = [r.predicted for r in rows if labels[r.doc_id]]
    clean = [r.predicted for r in rows if not labels[r.doc_id]]
    assert right >= 0.93 and sum(caught) >= 0.7 * len(caught) and sum(clean) <= 0.03 * len(clean)


def test_folds(spark, sf_dir):
    for r in queries.op10_toxicity(spark, sf_dir).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


@pytest.mark.parametrize("word", ["idiot", "IDIOT", "1d10t", "!diot", "іdіоt", "ｉｄｉｏｔ", "ídiöt", "id​iot", "(idiot)", "idiot###", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d"])
def test_disguises(model, word):
    assert model.score(f"some plain words {word} about trains") >= 0.5


@pytest.mark.parametrize("text", ["", "idiotic behaviour", "the idiots", "an idiot proof machine", "a trash can", "words about trains"])
def test_harmless(model, text):
    assert model.score(text) < 0.5


def test_longer_texts_weigh_a_match_less(model):
    assert model.features("idiot " + "word " * 500)[1] < model.features("idiot " + "word " * 5)[1]


def test_stems_are_learned_from_their_rate():
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(500):
        words = [rng.choice(CLEAN) + rng.choice("abcd") for _ in range(80)]
        for k in range(80):
            if rng.random() < (0.06 if i % 4 == 0 else 0.0005):
                words[k] = "grummel" + "".join(rng.choice("aeiou") for _ in range(4))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts[:400], labels[:400])
    assert any("grummel".startswith(s) or s.startswith("grummel") for s, _ in model.stems)
    assert sum(int(model.score(t) >= 0.5) == y for t, y in zip(texts[400:], labels[400:])) >= 95


def test_odd_rows(spark, docs, odd_docs, no_docs, model):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(no_docs, none).count() == 0
    assert toxicity.toxicity(odd_docs, none).count() == 7
    odd_labels = spark.createDataFrame([(None, 1, 1), (5, 1, None), (3, 1, 2), (6, 0, 1), (6, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    texts, labels = toxicity.training_rows(docs, odd_labels)
    assert len(texts) == len(labels) <= 2
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    expected = [r.doc_id for r in docs.collect() if model.score(r.text or "") < 0.5]
    assert sorted(by_id(kept)) == sorted(expected)
