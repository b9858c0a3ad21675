import random

import pytest

KIND = "doc_id long, text string, lang string, row string, row_key long, doc_key long, deal int, n_lines long, shard int, source string, n_chars long"


def prose(rnd, n):
    syllables = ["an", "be", "cu", "do", "er", "fi", "go", "ha", "é", "ñu"]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n)]
    return "".join(w + (rnd.choice([".\n", " ", " ", " ", ", ", "  "])) for w in words)


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with nulls, empty and very long texts, ties, repeated rows, copies and shared passages."""
    rnd = random.Random(11)
    shared, base = prose(rnd, 70), prose(rnd, 300)
    rows = [(i, prose(rnd, rnd.choice([1, 3, 15, 40, 80, 200]))) for i in range(100, 140)]
    rows += [(i, prose(rnd, 30) + shared + prose(rnd, 20)) for i in range(200, 212)]
    rows += [(300 + k, base[: 40 * k] + prose(rnd, k) + base[40 * k :]) for k in range(12)]
    rows += [(400, rows[3][1]), (401, rows[3][1]), (402, base)]
    rows += [(500, "ab " * 400), (501, "x" * 5000), (502, "same line here with quite enough words\n" * 30)]
    rows += [(600, prose(rnd, 8000)), (None, prose(rnd, 60)), (None, None), (601, None), (602, ""), (603, " \n\t "), (604, "one"), (605, "ONE")]
    rows += [rows[5], rows[5], (100, prose(rnd, 90)), (100, "another text of a used id"), (606, "\x1c odd\x85spaces and <|endoftext|> marks")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """Those texts in a table with further columns, whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "xx", "r", 1, 2, 3, 4, 5, "s", len(t or "")) for i, t in texts], KIND).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KIND)
