import pytest

#: Columns of documents, and one more whose name the operators might use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, trigger string"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, first=0):
        rows = [(i + first, t, ["en", "de", None][i % 3], f"s{i % 2}", None if t is None else len(t), 7, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, tied, very long, without spaces, with rare characters."""
    import random

    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    prose = [" ".join(r.choice(words) for _ in range(r.randrange(5, 200))) + "." for _ in range(25)]
    return [
        None, "", "   \n\t ", "a", "one two", "one two three", *prose, prose[3], prose[3], prose[4] + " more", prose[5].upper(),
        " ".join(prose), "x" * 5000, "ab" * 3000, "ñandú Straße é́ 漢字かな ไทย 😀 <|endoftext|> İstanbul ΟΔΟΣ   \x1c½", "'s don't I'LL 123 ²",
    ]
