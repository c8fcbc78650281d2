import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
BASE = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood where nobody lives but owls and mice who sing all night long until dawn breaks again over quiet hills beyond the old river near our town"
WORDS = BASE.split()

#: (doc_id, text): nulls, empties, white space, ties, copies, near copies, a very long text, odd characters.
TEXTS = [
    (0, BASE),
    (1, BASE),
    (2, BASE.upper()),
    (3, BASE.replace("owls", "cats")),
    (4, None),
    (5, ""),
    (6, " \t\n\x0b "),
    (7, "one two three"),
    (8, "one  two\tthree"),
    (9, "one two four"),
    (10, LONG),
    (11, LONG + " end"),
    (12, "x"),
    (13, "Größe naïve 漢字 🎧 é, ﬁ ½ " * 12),
    (14, BASE + " " + BASE),
    (15, "before it all " + BASE + " and after that"),
    (16, "mail a.b+c@d-e.co.uk or x@@y, card 4111 1111 1111 1111, ip 1.2.3.4 and 1.2.3.999, +1 (212) 555-1234, IBAN GB82 WEST 1234 5698 7654 32, token = \"abcdef0123456789abcd\""),
    (17, "\n".join(["same line here"] * 30)),
    (18, " ".join(WORDS[:35])),
    (19, " ".join(WORDS[5:40])),
    (20, "a"),
    (None, "nobody knows this one"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """TEXTS with clashing extra columns, over several partitions, and one row twice."""
    rows = [(d, t, "en", "src0", len(t or ""), d, 1.0, "x", True) for d, t in [*TEXTS, TEXTS[12]]]
    kind = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, ids string, kept boolean"
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(d, d % 2, int(d % 3 == 0)) for d in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
