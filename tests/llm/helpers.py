"""Small corpora with copies, near copies, nulls, empty and long texts, repeated rows, and columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n: int = 40, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def prose(size: int) -> str:
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", ".\n"]) for _ in range(size)).strip()

    passage = prose(80)
    rows: list[tuple] = []
    for k in range(n):
        kind = k % 8
        if kind == 1 and rows:
            text = rng.choice([r[1] for r in rows if r[1]])
        elif kind == 2 and rows:
            text = rng.choice([r[1] for r in rows if r[1]]) + " " + rng.choice(words)
        elif kind == 3:
            text = prose(20) + "\n" + passage + "\n" + prose(20)
        elif kind == 4:
            text = prose(5).upper()
        else:
            text = prose(rng.randint(1, 120))
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "Z", None]), len(text)))
    rows += [(n, None, "en", "a", None), (n + 1, "", "en", "b", 0), (n + 2, " \t\n ", None, None, 4), (n + 3, "word " * 3000, "en", "a", 15000)]
    return rows


def frame(spark, rows: list[tuple], clash: bool = True):
    """The rows, with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for name in ("key", "id", "rank", "size", "kept", "taken", "line", "cluster", "shard", "first"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df
