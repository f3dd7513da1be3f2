"""Small tables with nulls, repeats, ties, long texts and clashing column names."""

import random

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id string, kept string, component string, n long, row int, spans string, bin string, score string"
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi".split()


def doc(doc_id, text, source="s1"):
    return (doc_id, text, "en", source, 1, "x", "x", "x", 7, 7, "x", "x", "x")


def docs(spark, rows):
    return spark.createDataFrame([doc(*r) for r in rows], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    words = text.split()
    for i in range(len(words)):
        if r.random() < share:
            words[i] = f"edit{r.randrange(10_000)}"
    return " ".join(words)
