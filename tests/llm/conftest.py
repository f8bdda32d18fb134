import random

import pytest

SYLLABLES = {"en": ["the", "an", "er", "in", "sh", "ing", "on", "ea"], "de": ["ung", "ein", "sch", "ver", "keit", "lich", "ß"], "fr": ["eau", "oi", "qu", "tion", "é", "ent", "aux"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, junk, nulls, empty, tiny and long texts."""
    rng = random.Random(5)
    rows = []

    def add(text, lang="en", source=None, doc_id=None):
        i = len(rows) if doc_id is None else doc_id
        rows.append((i, text, lang, source or f"src{i % 4}", len(text) if text is not None else None))

    for i in range(120):
        lang = ["en", "de", "fr"][i % 3]
        add(prose(rng, lang, rng.randint(60, 200)), lang)
    for i in range(8):
        add(rows[3][1], "de", "src0")
    base = rows[6][1].split()
    for i in range(6):
        near = list(base)
        for k in range(1 + i):
            near[rng.randrange(len(near))] = f"edit{i}{k}"
        add(" ".join(near))
    passage = prose(rng, "en", 70)
    for i in range(5):
        add(f"{prose(rng, 'en', 60)} {passage} {prose(rng, 'en', 60)}")
    fuzzy = passage.split()
    fuzzy[20], fuzzy[45] = "changed", "altered"
    add(f"{prose(rng, 'en', 50)} {' '.join(fuzzy)} {prose(rng, 'en', 50)}")
    for i in range(10):
        add(" ".join(rng.choice(["###", "$$$", "|", "!!"]) + "".join(rng.choice("XQZ#%") for _ in range(6)) for _ in range(90)))
    add(None)
    add("")
    add("   \n\t ")
    add("one")
    add("two words here")
    add("12345 678 90")
    add(prose(rng, "en", 9000), source="src0")
    add("word " * 400)
    add("a\x0bb\x1cc d " * 30)
    add("line one here\nline one here\n\nline two\nline one here\n" * 3)
    add("text without language", None, None)
    rows.append((len(rows), "no source " * 30, "en", None, 300))
    rows.append(rows[10])
    rows.append((None, "row without id " * 20, "en", "src1", 300))
    rows.append((20, prose(rng, "fr", 80), "fr", "src2", 400))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd_columns(docs):
    """The same rows with further columns whose names operators use inside, or nearly."""
    from pyspark.sql import functions as F

    names = ("size", "Shard", "slot", "Perplexity", "threshold", "kept", "component", "token", "Key", "hash", "copies", "id", "n", "part", "place", "rank", "ROW", "x", "a", "b")
    names += ("__text", "__Lang", "__own", "__source", "__size", "__id", "__copy", "TEXT_KEY", "a`b", "c.d", "batch", "item", "bits", "stratum")
    for name in names:
        docs = docs.withColumn(name, F.lit("own"))
    return docs


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(r[0], 0 if r[1] and "###" in r[1] else 1, 0) for r in corpus if r[0] is not None and r[1]]
    return spark.createDataFrame([*rows, (99999, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
