import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LINE = "The river rose over the old stone bridge before noon and then fell back to its bed."
BASE = " ".join(f"w{i}" for i in range(120))

# Nulls in every column, empty and long texts, ties, repeated rows, junk, marks and other scripts.
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "b", 1), (3, BASE.replace("w7 ", "x "), "en", "a", 1), (4, None, "en", "a", None), (5, "", "en", None, 0),
    (6, "short text", None, "b", 9), (6, "short text", None, "b", 9), (7, "only four words here", "en", "c", 2), (8, "ONLY four Words here", "en", "c", 2),
    (9, " \t\n \x0b\x0c\r ", "en", "c", 2), (10, (LINE + "\n") * 12, "en", "a", 3), (11, "\n".join(" ".join(f"t{i}_{j}" for j in range(15)) + "." for i in range(2000)), "en", "a", 3),
    (12, "a$$$ b%%% c### d&&& " * 30, "en", "a", 3), (13, "Über día — naïve “quoted” 日本語 \U0001d11e ok x", "de", "d", 3), (14, "x" * 200_000, "en", "a", 3),
    (15, " ".join(f"v{i}" for i in range(40)) + "\nReleased under the MIT License.", "en", "b", 3), (16, "home | about | contact | help\n" + LINE, "en", "b", 3),
    (17, " ".join(["same"] * 50), "en", "b", 3), (18, "don't 're <|endoftext|> i'm 42", "en", "b", 3), (None, BASE, "en", "b", 3), (20, BASE + " tail words after it", "fr", None, 5),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def odd(docs):
    """Columns whose names an operator might use itself."""
    names = ("key", "size", "score", "n", "node", "source_size", "range", "before", "features", "rank", "_tie", "times", "target", "kept", "y", "part", "term")
    return docs.selectExpr("*", *[f"lang AS {n}" for n in names])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 0 if i in (12, 16, 17) else 1, int(i in (10, 11))) for i in range(1, 19)] + [(None, 1, 0), (7, None, None), (1, 1, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
