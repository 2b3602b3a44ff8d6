import pytest

from tests.llm.helpers import prose

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, g long, h long, key string,"
          " log_weight double, draw_key double, _matches string, _values string, component_id long, task int, length int")


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, very long, repeated and short texts, null ids, and columns whose names operators use themselves."""
    long = prose(1, 120_000)
    texts = [(1, None), (2, ""), (3, long), (4, long), (5, "one"), (6, "one"), (6, "one"), (None, "no id here at all"),
             (None, None), (7, " \n\t "), (8, prose(2, 300)), (9, prose(2, 300) + " tail"), (-5, "Ünïcode 日本語 <|endoftext|> x"),
             (1 << 60, prose(3, 50))]
    rows = [(i, t, None, "src0", None if t is None else len(t), 7, 7, 7, "k", 1.0, 1.0, "m", "v", 3, 4, 5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
