import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def made(seed=0, n=60):
    """Documents with copies, near copies, shared passages, and every odd case."""
    rng = random.Random(seed)
    en = [a + b for a in ("the", "ing", "and", "ther", "wh") for b in ("", "ation", "ed", "er", "ly", "est")]
    fr = [a + b for a in ("eau", "aux", "elle", "que", "é") for b in ("", "ment", "tre", "oi", "è", "ier")]
    rows = []
    passage = prose(rng, [f"w{i}" for i in range(500)], 60)
    for i in range(n):
        lang = "fr" if i % 3 == 0 else "en"
        body = "\n".join(prose(rng, (fr if lang == "fr" else en) + [f"x{rng.randint(0, 400)}" for _ in range(30)], rng.randint(1, 40)) for _ in range(rng.randint(1, 9)))
        if i % 7 == 0:
            body += "\n" + passage
        rows.append((i, body, lang, f"s{i % 4}", len(body)))
    for j, i in enumerate((3, 3, 3, 8, 21)):
        rows.append((n + j, rows[i][1], rows[i][2], "copy", rows[i][4]))
    for j, i in enumerate((5, 5, 11, 14)):
        w = rows[i][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((n + 10 + j, " ".join(w), rows[i][2], "near", 0))
    long_ = "\n".join(prose(rng, en, 30) for _ in range(300))
    rows += [
        (n + 20, None, "en", "odd", None), (n + 21, "", "en", "odd", 0), (n + 22, "   \n\t ", None, "odd", 6), (n + 23, "12 34 !!", None, "odd", 8),
        (n + 24, long_, "en", "odd", len(long_)), (n + 25, "a" * 5000, None, None, 5000), (None, "without an id the ther ing", "en", None, 27), (n + 27, "é 😇💩 ß", "fr", "odd", 6),
        (n + 28, rows[4][1], "en", "twice", 1), (n + 28, rows[4][1], "en", "twice", 1), (n + 29, "AN AND ANDER\r\nand ander", "en", "odd", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def stored(docs, tmp_path_factory):
    """The folder of a table documents."""
    folder = str(tmp_path_factory.mktemp("stored"))
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    """A few documents with columns named like the operators' own."""
    names = "lang_pred score token_ids pieces sequence_id offset fingerprint media payload_bytes pii_spans pii_text n_lines n_removed component_id root key doc tag part".split()
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows[:8], SCHEMA).withColumns({n: F.lit("mine") for n in names})
