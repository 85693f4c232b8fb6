"""Messy inputs that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, score string, h string, spans string, sig string, term string, n_tokens string"
LABELS = "doc_id long, quality int, toxic int, text string"


def prose(seed: int, n: int = 80) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("river stone lamp cloud green walk seven paper under light moon table north glass voice early".split()) + r.choice(["", "", "s", "ed", "ing", ","]) for _ in range(n))


def docs(spark, texts):
    """Rows (doc_id, text) with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", len(t or ""), "x", "x", "x", "x", "x", "x", "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def messy(spark):
    long = prose(99, 30_000)
    same = prose(5, 60)
    return docs(spark, [(None, prose(1)), (1, None), (2, ""), (3, "  \n \t"), (4, long), (5, same), (5, same), (6, same), (7, "é ß 漢字 😀 ñ"), (8, "x")])


def labels(spark, rows=()):
    return spark.createDataFrame([(*r, "clash") for r in rows], LABELS)
