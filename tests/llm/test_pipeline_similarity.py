"""The pipeline against plain versions, its near_dedup held to five words and a similarity of 0.8."""

import corpus_pipeline
from kiteloom.llm import packing, queries, secrets, toxicity

from .test_mixing import plain_targets, words
from .test_neardup import five, linked
from .test_pipeline import fixture
from .test_simhash import groups


def test_stages_on_what_their_predecessors_kept(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = queries.table(spark, str(tmp_path), "documents")
    model = toxicity.fit(*toxicity.training_rows(docs, queries.table(spark, str(tmp_path), "labels")))
    scanner = secrets.trained()
    given, out = docs.collect(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, out, str(tmp_path))
        assert found.columns == docs.columns, name
        rows = found.collect()
        texts = {r.doc_id: r.text for r in given}
        if name == "toxicity":
            assert sorted(r.doc_id for r in rows) == sorted(k for k, t in texts.items() if model.score(t) < 0.5)
            assert len(rows) < len(given)
        elif name == "near_dedup":
            sets = {k: five(t) for k, t in texts.items()}
            root = groups(sets, [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])])
            assert sorted(r.doc_id for r in rows) == sorted(k for k in root if root[k] == k)
            assert len(rows) < len(given)
        elif name == "secrets":
            plain = {k: secrets._without(t, secrets.find([t], scanner)[0], "[SECRET]") for k, t in texts.items()}
            assert {r.doc_id: (r.text, r.n_chars) for r in rows} == {k: (t, len(t)) for k, t in plain.items()}
        else:
            sizes = {}
            for r in given:
                sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
            for source, n in plain_targets(sizes).items():
                assert sum(words(r.text) for r in rows if r.source == source) == int(n + 0.5)
            assert all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in rows)
        given, out = rows, spark.createDataFrame(rows, docs.schema)

    encode = packing.encoder(queries.vocabulary("byte_bpe_50k.json"), None).encode
    expected = {}
    for r in given:
        ids = [*map(int, encode(r.text)), 0]
        expected.setdefault((r.doc_id, len(ids)), []).append(ids)
    times = {k: [0] * k[1] for k in expected}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = [int.from_bytes(p.ids[i : i + 4], "little") for i in range(0, len(p.ids), 4)]
        key = p.doc_id, p.doc_tokens
        assert len(ids) == p.length and p.length & (p.length - 1) == 0
        assert all(ids == own[p.start : p.start + p.length] for own in expected[key])
        for i in range(p.start, p.start + p.length):
            times[key][i] += 1
    assert all(n == len(expected[k]) for k, seen in times.items() for n in seen)
