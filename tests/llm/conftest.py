import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, uid long, key string, label string, q_uid string"


@pytest.fixture()
def table(spark, tmp_path):
    """table(rows, schema) -> a Parquet table of three files."""
    made = []

    def make(rows, schema=COLUMNS):
        path = str(tmp_path / f"t{len(made)}")
        made.append(path)
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture()
def odd(table):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    columns whose names clash with the operators' own."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    texts = [None, "", " \n\t\n", "one", "one two three", "same text here for all of them\nand a line", "same text here for all of them\nand a line", long,
             "a\x00b ünïcödé 🙂 text here", "x" * 5000]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), 7, "k", "l", "q") for i, t in enumerate(texts)]
    rows += [rows[5], rows[7], (None, "one", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return table(rows)


@pytest.fixture()
def empty(table):
    return table([])
