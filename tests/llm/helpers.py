"""Small tables with everything odd: nulls in any column, empty and long texts, ties, repeated rows, extra columns with names that operators use."""

import random

CLASHING = "n_tokens string, kept string, score string, fp string, part int, term string, lo int, doc string, k string, component_id string, _spans string, vote double, gram int, level int"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASHING
N_EXTRA = CLASHING.count(",") + 1


def sentence(rng, n, words=None):
    words = words or ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "upsilon"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "s", "ed", "ing", "er", "ly"]) for _ in range(n))


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *(("en", "s") if len(r) == 2 else ()), len(r[1] or ""), *([None] * N_EXTRA)) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows(seed=1):
    rng = random.Random(seed)
    same = sentence(rng, 80)
    return [
        (0, None), (1, ""), (2, " \t\n"), (3, "word"), (4, sentence(rng, 20_000)), (5, same), (6, same), (6, same), (7, "é中😀   ß" * 20),
        (8, "x" * 50_000), (9, sentence(rng, 60), None, None), (10, "\n\n a \n a \n a"), (11, "### </turn> <|also|> \\ \x00".replace("\x00", "")), (None, sentence(rng, 90)),
    ]
