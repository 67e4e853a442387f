import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, _k1 string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of all awkward kinds: nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    import random

    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7)))
    vocabulary = [word() for _ in range(400)]
    prose = lambda n: "".join(r.choice(vocabulary) + ("\n" if r.random() < 0.08 else " ") for _ in range(n))
    shared = "\n".join(prose(30).replace("\n", " ") for _ in range(3))
    rows = []
    for i in range(40):
        text = prose(r.randint(60, 260))
        if i % 5 == 0:
            text += "\n" + shared + "\n" + prose(20)
        rows.append((i, text, "en" if i % 3 else "de", f"s{i % 4}"))
    base = rows[7][1].split(" ")
    rows += [(100 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :]), "en", "s1") for k in range(6)]
    rows += [(120, rows[3][1], "en", "s0"), (121, rows[3][1], "fr", "s0"), (3, rows[3][1], "en", "s3"), (3, rows[3][1], "en", "s3")]
    rows += [(130, None, "en", "s1"), (131, "", None, None), (132, " \n\t ", "en", None), (None, rows[9][1], "en", "s2"), (None, None, None, None), (133, "one", "en", "s1"), (134, "one", "en", "s1"), (135, prose(20_000), "en", "s2"), (136, "é " * 70 + "日本 naïve 1234 <|endoftext|>", "xx", "s2")]
    return spark.createDataFrame([(*x, len(x[1] or ""), "e", "clash") for x in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
