"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

WORDS = [f"w{i * 7919 % 10007}" for i in range(4000)]
PASSAGE = "\n".join(" ".join(WORDS[20 * i : 20 * i + 20]) for i in range(60, 66))
LONG = " ".join(WORDS[(i * i) % 4000] for i in range(30000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, mix string, place int, _m int, _th int, _unit int, copies int, target int, size int, id int"


def text(a: int, n: int = 80) -> str:
    return "\n".join(" ".join(WORDS[i : i + 10]) for i in range(a, a + n, 10))


def documents(spark, empty: bool = False):
    rows = [
        (1, text(0), "en", "a"), (2, text(100), "en", "b"), (3, text(0), "en", "a"), (4, None, "en", "a"),
        (5, "", None, None), (6, " \t\n", "de", "b"), (7, LONG, "en", "c"), (8, text(200) + "\n" + PASSAGE, "en", "a"),
        (9, text(300) + "\n" + PASSAGE, "fr", "b"), (9, text(300) + "\n" + PASSAGE, "fr", "b"), (10, "one two", "fr", None),
        (None, text(400), None, "a"), (None, text(0), "en", None), (11, text(0).replace("w0 ", "changed "), "en", "a"),
        (12, "one two", "en", "b"), (13, "Ünï " * 60, "de", "c"), (14, "AB! " * 80, "de", "c"), (15, "x" * 3000, "de", "a"),
        (16, text(0)[:-3] + " é", "en", "a"), (17, "a  b   c \n d \n\n  e " * 20, "en", "d"),
    ]
    rows = [] if empty else [(i, t, la, s, len(t or ""), "x", "y", 1, 2, 3, 4, 5, 6, 7, 8) for i, t, la, s in rows]
    return spark.createDataFrame(rows, SCHEMA)
