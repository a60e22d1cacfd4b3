"""Small document frames with every awkward case, and brute-force helpers."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _uid string, hits string, guess string, score string, n int"
WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliett", "kilo", "lima", "mike",
         "november", "oscar", "papa", "quebec", "romeo", "sierra", "tango", "uniform", "victor", "whiskey", "xray", "yankee", "zulu"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", ",", "."]) for _ in range(n))


def awkward(seed: int = 1) -> list[tuple]:
    """(doc_id, text) with nulls, blanks, one-word, repeated, near-equal,
    very long and repeated-id rows."""
    rng = random.Random(seed)
    base = prose(rng, 80)
    edited = base.replace("alpha", "beta", 1) + " tail"
    long = "\n".join(prose(rng, 200) for _ in range(60))
    docs = [(1, base), (2, base), (3, base.upper()), (4, edited), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one"),
            (10, "One two"), (11, long), (12, long + " end"), (13, prose(rng, 90)), (14, "123 456 --- 789"), (None, base), (None, None),
            (13, prose(rng, 70)), (15, base), (15, base)]
    return docs


def frame(spark, rows, parts: int = 3):
    """A frame of documents with extra columns that clash with inner names."""
    full = [(i, t, "en", "src", None if t is None else len(t), "u", "h", "g", "s", 7) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)


def find_root(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def write_tables(spark, path: str, **tables) -> str:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return path
