import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, th string, h long, score string, rep string, size string, held string, c string, part string, kept string, rank string, u string, low string, quality string, item_id string, word string"
WORDS = {"en": "the of and thing bleed other ration hound estion ingly under thorn".split(), "de": "der und schacht keit pfau verein lichtung zuerst über heit ach einig".split(), "es": "el que ción mente asco llegó osito para niñez doblar queja boca".split()}


def prose(rng, lang="en", n=80, line=12):
    words = [rng.choice(WORDS[lang]) + rng.choice(WORDS[lang])[:2] for _ in range(n)]
    return "\n".join(" ".join(words[k : k + line]) for k in range(0, n, line))


def rows_of(texts):
    """(doc_id, text, lang, source) with clashing extra columns."""
    return [(i, t, lang, s, None if t is None else len(t), *[None if k % 2 else 1 if n in ("k", "h") else "x" for n, k in zip(SCHEMA.replace(" long", "").replace(" string", "").split(", ")[5:], range(99))]) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls everywhere, empty and very long texts, repeats, ties and clashing columns."""
    rng = random.Random(4)
    long = prose(rng, "en", 20_000)
    same = prose(rng)
    texts = [(1, None, None, None), (2, "", "en", "s1"), (3, " \n\t ", "en", None), (4, long, "en", "s1"), (5, same, "en", "s2"), (6, same, "en", "s2"), (6, same, "en", "s2"), (7, same, "de", None), (None, same, None, "s3"),
             (None, None, "de", "s1"), (8, "one two", "en", "s1"), (9, "one two", "es", "s3"), (10, "12345 !!!", "en", "s1"), (11, "日本語 テキスト", "ja", "s4"), (8, prose(rng, "de"), "de", "s1")]
    texts += [(20 + k, prose(rng, lang, 60 + k), lang, f"s{k % 3}") for k, lang in enumerate(["en", "de", "es"] * 8)]
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
