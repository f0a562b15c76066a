import time

import numpy as np

from kiteloom.llm import queries, secrets

KEY = "ghp_x7Kq93LmZ2vTtR8wYbN5cHd0QaJsUe1f"
PATH = "many/plain/parts/of/some/path/that/goes/on/and/on/until/here/"


def test_a_secret_anywhere_in_a_long_candidate():
    scanner = secrets.trained()
    for before in (PATH, PATH * 3, PATH * 40):
        for after in ("", "/and/more/parts/after/it/" + PATH):
            text = f"see {before}{KEY}{after} end"
            at = text.index(KEY)
            spans = secrets.find([text], scanner)[0]
            assert any(s <= at and at + len(KEY) <= e for s, e, *_ in spans), text
            assert all(e <= len(text) - 4 and s >= 4 for s, e, *_ in spans)
        assert secrets.find([f"see {before} end"], scanner)[0] == []


def test_candidates_against_plain_rule():
    import re

    text = f"a1 abcdefg1 x {PATH}{KEY} ABCDEFGHIJKLMNOP 12345678 12345678901234567 _b2-c3=d4 é1234567z 1.2.3.4.5.6.7.a {'z' * 40}9 9{'y' * 14} w{'1a' * 7}"
    expected = sorted(m.span() for m in re.finditer("[A-Za-z0-9+/_=.-]+", text) if len(m[0]) >= 16 or len(m[0]) >= 8 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]))
    assert sorted(secrets.candidates(text)) == expected
    assert secrets.candidates("") == []


def test_windows_cover_a_candidate():
    for size in (1, 16, 47, 48, 49, 80, 81, 500):
        at = secrets.windows(10, 10 + size)
        assert set(range(10, 10 + size)) == {i for s, e in at for i in range(s, e)}
        for start in range(10, 10 + size - 15):
            assert size < 16 or any(s <= start and start + 16 <= e for s, e in at)


def test_network_against_a_naive_convolution():
    net = secrets.trained().network
    codes, _ = secrets.labelled_findings(5, 9)
    for row, got in zip(codes, net.logits(codes)):
        pooled = np.zeros(2 * net.filters)
        for f in range(net.filters):
            best = [0.0, 0.0]
            for at in range(len(row) - net.width + 1):
                total = float(net.p["b"][f])
                for k in range(net.width):
                    for d in range(net.p["e"].shape[1]):
                        total += float(net.p["e"][row[at + k]][d]) * float(net.p["w"][k * net.p["e"].shape[1] + d, f])
                side = 0 if secrets.BEFORE <= at + net.width // 2 < secrets.BEFORE + secrets.INSIDE else 1
                best[side] = max(best[side], total)
            pooled[f], pooled[net.filters + f] = best
        assert abs(float(pooled @ net.p["o"] + net.p["c"][0]) - float(got)) < 1e-3


def test_a_megabyte_of_candidates():
    scanner = secrets.trained()
    for text in (f"{KEY} " * 27_000, "token=abcdefgh1 " * 65_000, "a1" * 500_000, "a" * 5_000_000, f"{PATH}{KEY}/" * 10_000):
        began = time.monotonic()
        secrets._without(text, secrets.find([text], scanner)[0], "[SECRET]")
        assert time.monotonic() - began < 10


def test_letters_in_a_row_are_no_secret():
    assert secrets.find(["q" * 100_000, "word/" * 500, "haystackwithoutanyspaces" * 4], secrets.trained()) == [[], [], []]


def test_recall_on_documents_held_out_from_training(spark):
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents")
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    half = ids[len(ids) // 2]
    scanner = secrets.trained_on(docs.where(f"doc_id < {half}"))
    found = [(w, y) for r in docs.where(f"doc_id >= {half}").collect() for w, y in secrets.text_findings(r.text or "")]
    p = scanner.probabilities(secrets.codes_of([w for w, _ in found])) >= scanner.threshold
    y = np.array([label for _, label in found])
    assert y.sum() >= 100 and p[y].mean() >= 0.95 and p[~y].mean() <= 0.02


def test_training_on_nothing_and_on_odd_rows(no_docs, odd_docs):
    assert secrets.trained_on(no_docs).threshold == secrets.fitted(*(tuple(a[np.random.default_rng(5).permutation(3000)] for a in secrets.labelled_findings(3000, 5 + k)) for k in (0, 1)), 0.98).threshold
    assert 0 < secrets.trained_on(odd_docs).threshold < 1


def test_all_documents_are_learned_from(spark):
    """Every labelled window of every text counts: none is left out beyond a number of documents, or of windows of one."""
    rows = [(i, f"see page build-{i:05}.1 and invoice AB-2020-{i:06} then") for i in range(4500)] + [(4500, " ".join(f"order release-{i:04}.7 x" for i in range(50))), (4501, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {f for _, t in rows for f in secrets.text_findings(t or "")}
    assert {(bytes(r.seen), r.secret) for r in secrets.labelled_windows(df).collect()} == expected
    assert len(expected) > 9000


def test_rounds_are_means_of_parts_and_repeat(spark):
    texts = [f"see page build-{i:05}.1 and password = pw{i:05}kd9 then" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = (secrets.trained_on(d) for d in (df.repartition(1), df.repartition(5)))
    assert np.array_equal(one.network.packed(), two.network.packed()) and (one.scale, one.shift, one.threshold) == (two.scale, two.shift, two.threshold)
    assert not np.array_equal(one.network.packed(), secrets._started(3000, 0.98, 5).network.packed())


def test_planted_tokens_through_the_scan(spark):
    rows = [(1, f"plain words then {PATH}{KEY} end"), (2, "plain words alone"), (3, None), (4, f"client credential = '{KEY}' ok")]
    spans = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s.kind for s in spans[1]] == [s.kind for s in spans[4]] == ["network"]
    assert not spans[2] and not spans[3]
