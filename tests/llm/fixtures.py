"""Documents with the awkward cases: null and empty texts, ties, repeated rows, clashing columns, near copies."""

import random


def rows(seed=1, n=70):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "délta", "eps", "zeta,", "Eta.", "theta"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 90))) for _ in range(8)]
    out = []
    for i in range(n):
        text = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        text = " ".join(text)
        if rng.random() < 0.3:
            text = "\n".join([text[:60], "a line that many documents share, in all of its words", text[60:]])
        out.append((i * 3, text))
    out += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "One  TWO"), (1005, "x" * 400), (1006, "x" * 300), (1007, "漢字👍" * 40)]
    return out


def frame(spark, data):
    """With columns that share names with those inside the operators."""
    extra = [(d, t, "en", "s", 7, "k", 1, b"f", 2, "h") for d, t in data]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, key string, slot int, flags binary, size int, hash string")
