import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, shard string, score string, h string, host string, fp string"


def made(rows):
    """Rows of documents with further columns whose names the operators use inside."""
    return [(i, t, lang, "s", None if t is None else len(t), "x", "x", "x", "x", "x", "x") for i, t, lang in rows]


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, ties, repeated rows, copies, near copies, every kind of white space and letter."""
    rng = random.Random(7)
    syllables = {"en": "the th ing er an on ed re ti st".split(), "fr": "le é eau ou ment que re è la ai".split(), "de": "der ß sch ä ung ein ü lich en zu".split()}

    def prose(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))

    out = [(k, prose(lang, rng.randint(5, 120)), lang) for k, lang in enumerate(["en", "fr", "de"] * 20)]
    long = prose("en", 30_000)
    passage = prose("fr", 80)
    out += [
        (100, None, "en"), (101, None, None), (102, "", "en"), (103, "", None), (104, "   \n\t ", "en"), (105, "12 34 !!", "de"),
        (106, out[0][1], "en"), (107, out[0][1].upper().lower().swapcase(), "en"), (108, out[0][1].capitalize(), "en"),
        (109, long, "en"), (110, long + " x", "en"), (111, long, None), (112, "One", "en"), (113, "one", "en"), (114, "ONE two", "en"),
        (115, "a  b\u00a0c\u2003d \x1c e\r\n\r\nf's don't DON'T İstanbul ǅ ﬁ e\u0301 \u0301x 5\u00bd٣ \U0001f600\U0001f600 <|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "en"),
        (116, "word " * 50 + passage + " tail " * 9, "fr"), (117, "other " * 40 + passage + " end" * 5, "fr"),
        (None, "no id here", "en"), (None, "no id here", "en"), (None, None, None), (118, "tie tie tie", "en"), (118, "tie tie tie", "en"),
        (-5, "negative id the thing", "en"), (2**62, "large id the thing", "en"),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(made(rows), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
