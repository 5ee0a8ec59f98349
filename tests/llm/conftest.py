import pytest

BIG = 2**60 + 1
LONG = "".join(f"w{i} {'lorem ipsum dolor sit amet' if i % 7 else ''}\n" for i in range(9000))
PASSAGE = "The quick brown fox jumps over the lazy dog and then it sleeps for the rest of the day under a tree."


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source, and columns named like the operators' own)."""
    texts = [(1, "one two three four five six seven eight nine ten eleven"), (1, "one two three four five six seven eight nine ten eleven"),
             (2, "ONE two three four five six seven eight nine ten eleven"), (3, None), (4, ""), (None, None), (None, "a text without an id"),
             (None, "a text without an id"), (5, LONG), (6, f"x {PASSAGE} y"), (7, f"{PASSAGE}"), (8, PASSAGE), (BIG, f"äöü {PASSAGE} \U0001F600 ß"),
             (9, "   \n\t "), (10, "1234 5678 !!!"), (1, "same id, another text")]
    return [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 2}", 1, 2, "c", 3.0, True, 4, "k", 5, 6, 7) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def schema():
    return ("doc_id long, text string, lang string, source string, size long, shard int, doc string, score double, kept boolean, part int, "
            "key string, fp long, n_words int, _id int")


@pytest.fixture(scope="session")
def edge(spark, edge_rows, schema):
    return spark.createDataFrame(edge_rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark, schema):
    return spark.createDataFrame([], schema)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark, smoke_dir):
    return spark.read.parquet(f"{smoke_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text for r in small.collect()}


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is None, x))
