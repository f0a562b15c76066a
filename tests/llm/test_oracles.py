"""The SQL of op5 and op6 against the operators, on odd rows."""

import duckdb
import pytest

from kiteloom.llm import chat, queries, suffix


def answers(sql, **tables):
    with duckdb.connect() as db:
        for name, table in tables.items():
            db.register(name, table)
        found = db.execute(sql)
        names = [c[0] for c in found.description]
        return sorted((dict(zip(names, row)) for row in found.fetchall()), key=repr)


def plain(df, names):
    return sorted(({n: r[n] for n in names} for r in df.collect()), key=repr)


@pytest.mark.parametrize("table", ["docs", "odd_docs"])
def test_removed_bytes(request, table):
    given = request.getfixturevalue(table)
    want = answers(suffix.REMOVED_SQL, documents=given.select("doc_id", "text").toArrow())
    assert sum(r["n_removed"] for r in want) and sum(r["n_spans"] for r in want)
    assert plain(suffix.remove_repeats(given, 200), want[0]) == want


def test_formatted_conversations(spark, tmp_path):
    rows = [
        (1, 0, "user", "a \\ b <|im_end|>\n<\\| c"),
        (1, 1, "assistant", "\U0001f642 <|<|x"),
        (1, 2, "assistant", None),
        (2, 0, None, "no role"),
        (2, 0, "a\nb", ""),
        (3, 5, "user", "twice"),
        (3, 5, "user", "twice"),
        (None, None, "assistant", "no id"),
    ]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    want = answers(chat.FORMATTED_SQL, conversations=table.toArrow())
    assert len(want) == 5
    assert plain(queries.op6_chat(spark, str(tmp_path)), want[0]) == want
