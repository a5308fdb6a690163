"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, route string, kind string"


def passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(n))


def documents(spark, rows=None):
    """Rows of (doc_id, text, source); the extra columns clash with internal names."""
    if rows is None:
        shared, other = passage(1, 60), passage(2, 25)
        rows = [(i, passage(100 + i, 30 + 7 * i), f"s{i % 3}") for i in range(12)]
        rows += [(20 + i, f"{passage(200 + i, 8)} {shared}\n{passage(300 + i, 9)}", "s0") for i in range(9)]
        rows += [(40, rows[3][1], "s1"), (41, rows[3][1], None), (42, rows[3][1] + " ende", "s2"), (43, "\t" + rows[5][1].replace(" ", "  "), "s1")]
        rows += [(50, None, "s0"), (51, "", None), (52, " \n\t ", "s1"), (53, "eins", "s9"), (54, "Orre " * 400, "s2"), (55, other + "\n" + other, "s2")]
        rows += [(60, passage(7, 40), "s1"), (60, passage(7, 40), "s1"), (60, passage(8, 40), "s1"), (None, passage(9, 33), "s2"), (None, None, None)]
        rows += [(70, " ".join(passage(500 + i, 20) for i in range(300)), "s0")]
        rows += [(71 + i, f"zeile {i}\n{shared}", f"s{i}") for i in range(7)]
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), "r", "k") for d, t, s in rows], SCHEMA)


def rows_of(df, *columns):
    got = [tuple(r) for r in df.select(*columns or df.columns).collect()]
    return sorted(got, key=repr)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]
