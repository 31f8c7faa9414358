import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with nulls, empties, copies, near copies, a repeated row, clashing extra columns."""
    import random

    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    rows = [(i, " ".join(words(rnd.choice([3, 40, 90, 160])))) for i in range(60)]
    base = words(120)
    for i in range(60, 75):  # near copies
        own = list(base)
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(len(own))] = "changed"
        rows.append((i, " ".join(own)))
    passage = " ".join(words(60))
    rows += [(80, " ".join(words(30)) + "\n" + passage), (81, passage + " " + " ".join(words(45))), (82, passage), (83, passage), (84, passage.upper())]
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "one"), (94, "One"), (95, "tail " * 3000), (None, "no id here at all"), (96, "x" * 5000), (97, "é ü 日本 🙂 ß"), (97, "é ü 日本 🙂 ß")]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, "s", i, i, i, i) for i, t in rows], "doc_id long, text string, lang string, source string, size long, class long, key long, root long").repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
