import pytest

#: Columns whose names the operators use inside.
EXTRA = "text_hash string, size string, removed string, row string, fp string, taken string, position string, `pass` string, _id string, anchor string"
LONG = " ".join(f"word{i % 97} and{i % 89} more." for i in range(6000))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with further columns that clash by name."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] is not None else None, *["x"] * 10) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)

    return build


PLAIN = [
    "The first document tells of a river and of the boats that go down to the sea in spring.\nIt has a second line with some more words in it.",
    "Another text, about mountains this time, and the people who climb them in summer and in autumn.",
    "A third one. It repeats. It repeats. It repeats.\nIt repeats.",
]


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls, empty and blank texts, very long texts, repeated rows, one id with two texts."""
    return [
        (1, PLAIN[0]),
        (2, PLAIN[1]),
        (3, PLAIN[2]),
        (4, None),
        (5, ""),
        (6, " \n\t\n "),
        (7, PLAIN[0]),
        (8, PLAIN[0].replace("river", "rivers")),
        (9, LONG),
        (9, PLAIN[1] + " And something else."),
        (10, PLAIN[1], None),
        (10, PLAIN[1], None),
        (None, PLAIN[1]),
        (None, "Without an id, but with a text of its own to read, which nobody else has written down here."),
        (11, "one"),
        (12, "Ünïcödé 𝄞 text\nwith lines 𝄞𝄞 and more of them", "b"),
    ]


@pytest.fixture(scope="session")
def awkward(make_docs, awkward_rows):
    return make_docs(awkward_rows).cache()


@pytest.fixture(scope="session")
def nothing(make_docs, awkward):
    return awkward.limit(0)
