import random

import corpus_pipeline
from kiteloom.llm import mixing, packing, queries, secrets, simhash, toxicity

from .conftest import made_texts
from .test_mixing import plain_targets, words
from .test_neardup import five, linked
from .test_simhash import groups


def fixture(spark, folder):
    rng = random.Random(8)
    rows = []
    for i, text in enumerate(made_texts(80, 12)):
        toxic = i % 6 == 2
        rows.append((i, (text + " you idiot scum moron idiot") if toxic else text, "en", f"s{i % 4}", len(text), int(toxic)))
    rows += [(500 + i, rows[i * 3][1], "en", "s0", rows[i * 3][4], rows[i * 3][5]) for i in range(8)]
    rng.shuffle(rows)
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, r[5]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_plain_versions(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = queries.table(spark, str(tmp_path), "documents")
    labels = queries.table(spark, str(tmp_path), "labels")
    model = toxicity.fit(*toxicity.training_rows(docs, labels))
    kept = {r.doc_id: r for r in docs.collect() if model.score(r.text) < 0.5}
    sets = {k: five(r.text) for k, r in kept.items()}
    root = groups(sets, [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])])
    kept = {k: r for k, r in kept.items() if root[k] == k}
    scanner = secrets.trained()
    texts = {k: secrets._without(r.text, secrets.find([r.text], scanner)[0], "[SECRET]") for k, r in kept.items()}
    sizes = {}
    for k, r in kept.items():
        sizes[r.source] = sizes.get(r.source, 0) + words(texts[k])
    target = plain_targets(sizes)

    out, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
        seen.append(out.collect())
        out = spark.createDataFrame(seen[-1], docs.schema)
    assert sorted(r.doc_id for r in seen[0] if r.doc_id in root) == sorted(root)
    assert sorted(r.doc_id for r in seen[1]) == sorted(kept)
    assert {r.doc_id: (r.text, r.n_chars) for r in seen[2]} == {k: (t, len(t)) for k, t in texts.items()}
    for source, n in target.items():
        assert sum(words(r.text) for r in seen[3] if r.source == source) == int(n + 0.5)
    assert all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in seen[3])

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = packing.encoder(queries.vocabulary("byte_bpe_50k.json"), None).encode
    expected = sorted([*map(int, encode(r.text)), 0] for r in seen[3])
    cut = {}
    for p in pieces:
        ids = [int.from_bytes(p.ids[i : i + 4], "little") for i in range(0, len(p.ids), 4)]
        assert len(ids) == p.length and p.length & (p.length - 1) == 0
        cut.setdefault((p.doc_id, p.doc_tokens, p.start), []).append(ids)
    # Pieces of equal length and start that a document has twice are those of its two passes, which are equal.
    got = []
    for doc, total in {k[:2] for k in cut}:
        parts = [cut[k] for k in sorted(cut) if k[:2] == (doc, total)]
        got += [sum((p[n] for p in parts), []) for n in range(len(parts[0]))]
    assert sorted(got) == expected


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    assert mixing and simhash
