"""Small tables with the awkward rows every operator has to take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, value string, node long, raw string"


def word(rng: random.Random) -> str:
    return "".join(rng.choice(["ba", "ke", "li", "mo", "nu", "ra", "si", "to", "vy"]) for _ in range(rng.randint(1, 4)))


def prose(rng: random.Random, words: int) -> str:
    out = []
    while len(out) < words:
        sentence = [word(rng) for _ in range(rng.randint(4, 14))]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out[:words])


def documents(spark, rows, seed: int = 1):
    """(doc_id, text) or (doc_id, text, lang, source) rows with extra columns whose names clash with inner ones."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, "en", "s")[:4] if len(r) < 4 else r
        full.append((doc_id, text, lang, source, len(text or ""), 7, "x", 9, "y"))
    return spark.createDataFrame(full, DOCS).repartition(3)


def awkward(rng: random.Random):
    """Null, empty, blank, one-word, very long, repeated and tied rows."""
    base = prose(rng, 60)
    return [
        (None, None),
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "one"),
        (5, "One"),
        (6, base),
        (6, base),
        (7, base.upper()),
        (8, base.replace(" ", "  ")),
        (None, base),
        (9, prose(rng, 30_000)),
        (10, "naïve Ünïcödé \U0001f600 \U0001f600 text"),
        (11, "x" * 200_000),
    ]
