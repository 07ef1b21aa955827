import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, sig int, h int"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t), "x", 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(words, seed, share):
    r = random.Random(seed)
    return [f"e{r.randrange(10**6)}" if r.random() < share else w for w in words]


ODD = [(None, "no id at all"), (90, None), (91, ""), (92, " \n\t "), (93, "one"), (94, "é日本 😀 words"), (95, "x" * 300_000)]
