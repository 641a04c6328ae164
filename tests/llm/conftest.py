from __future__ import annotations

import pytest

#: doc_id, text, lang, source, n_chars, and columns whose names clash with the operators' own.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp long, size long, key string, "
          "component_id long, score double, words string, start long, length long")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, other white space, astral letters."""
    long = " ".join(f"w{i % 977} word{i % 13}" for i in range(60_000))
    texts = [None, "", " ", "one", "one two", "a b c d e f g", "a b c d e f g", "A b C d e f g", "x\n\ny \t z", long, long,
             "mail me@example.com and 10.0.0.1", "\U0001f600 naïve é " * 5, "1" * 20_000, "a" * 30_000, "@" * 5000 + "+" * 5000,
             "pay 4111 1111 1111 1111 now", "call +1 (555) 010-9999.", "<|endoftext|> is text"]
    rows = [(i, t, "en", ("s1", "s2", None)[i % 3], 1, i, i, "k", i, 0.5, "w", 0, 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id here at all", None, "s1", None, None, None, None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.9, 0.435]), (4, [0.62, 0.785]), (5, [0.0, 0.0]), (6, None),
            (7, [nan, 1.0]), (8, [inf, 1.0]), (9, []), (50, [0.0, -1.0]), (None, [0.0, -1.0]), (100, [1.0, None]), (150, [3.0])]
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, node long, cell int, weight long").repartition(2)
