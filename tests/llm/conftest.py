import numpy as np
import pytest

LETTERS = {"xa": "abcde", "yo": "fghij", "zu": "klmno"}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(list(LETTERS[lang]), rng.integers(2, 7))) for _ in range(words))


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Fixtures are small: two shuffle partitions keep the many little jobs short."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with a clashing extra column, nulls, empty, blank and very long texts, and repeated rows."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        lang = ("xa", "yo", "zu")[i % 3]
        rows.append((i, prose(rng, lang, int(rng.integers(3, 60))), lang, 1.0, i))
    rows += [(300, None, "xa", 1.0, 1), (301, "", None, 1.0, 1), (302, " \t ", "xa", 1.0, 1), (303, "12 34 !", "xa", 1.0, 1), (304, prose(rng, "yo", 9000), None, 1.0, 1)]
    rows += [rows[5], rows[5], (None, prose(rng, "zu", 12), "zu", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, text2 long")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, score double")
