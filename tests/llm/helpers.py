"""Small fixtures and plain brute-force versions."""

from __future__ import annotations

import hashlib
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, print long, key int"

WORDS = "[^\x20\x09-\x0D]+"


def doc_frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", 1, 2) for i, t, lang, src in rows], DOCS)


def prose(seed: int, n: int) -> str:
    """n different-looking words in sentences of ten."""
    words = [hashlib.md5(f"{seed}/{i}".encode()).hexdigest()[: 3 + i % 5] for i in range(n)]
    words = [re.sub("[0-9]", lambda m: "qrstuvwxyz"[int(m.group())], w) for w in words]
    return ".\n".join(" ".join(words[i : i + 10]) for i in range(0, n, 10))


def edge_rows():
    """Nulls, empties, ties, repeats and a very long text."""
    long = prose(1, 30_000)
    return [
        (1, prose(2, 60), "en", "a"), (2, prose(2, 60), "en", "a"), (2, prose(2, 60), "en", "a"), (3, None, "en", None),
        (4, "", None, "a"), (5, " \t\n\x0b\f\r ", None, None), (6, long, "en", "a"), (None, prose(3, 40), "en", "a"),
        (None, None, None, None), (7, "one two", "de", "b"), (8, "é \U0001d504 中文  x y", "de", "b"), (9, "same same " * 30, "en", "b"),
    ]
