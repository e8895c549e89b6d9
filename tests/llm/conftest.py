import random

import pytest
from pyspark.sql import functions as F

from tideline.llm import attention


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    """Tests of anything but the language model's own fit don't wait for it."""
    monkeypatch.setattr(attention, "STEPS", 60)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels=(), benchmark=(), extra=False):
    """A folder of tables as the queries read them; ``extra`` adds columns with names the operators use themselves."""
    d = spark.createDataFrame(docs, DOCS)
    if extra:
        for name in ("score", "n", "cls", "label", "rank", "ids", "rid", "part", "a", "b", "h", "low", "rep", "comp", "task", "length", "_nth", "held_out"):
            d = d.withColumn(name, F.lit(name))
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def sentence(rng, words=60):
    return " ".join("".join(rng.choice(["an", "re", "st", "io", "qu", "er", "th"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew potions"


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """Nulls everywhere, empty and blank texts, one very long text, repeated rows, clashing columns."""
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "A", "...", "漢字 かな", "🙂 🙂", "Mit License\nAll rights reserved.", "x" * 5000, sentence(rng, 20_000), "<|endoftext|> and 's", "\x1c\x85 ²½ ٣", ITEM]
    docs = [(i, t, None if i % 3 else "en", None, None) for i, t in enumerate(texts)]
    docs += [(100 + k, sentence(rng), "en" if k % 2 else "fr", "s", 1) for k in range(40)]
    docs += [docs[20], docs[20], docs[0], docs[9]]  # repeated rows
    docs += [(None, "text without an id", "en", None, None), (None, None, None, None, None), (200, docs[20][1], "en", None, 5), (201, docs[20][1] + " more", "fr", None, 5)]
    labels = [(100 + k, None if k % 7 == 3 else int(k % 2 == 0), None if k % 5 == 2 else int(k % 4 == 0)) for k in range(40)] + [(None, 1, 1), (100, 0, 1), (999, 1, 0)]
    items = [(0, None), (1, ""), (2, "short"), (3, ITEM), (None, ITEM), (4, ITEM)]
    return write(spark, tmp_path_factory.mktemp("edge"), docs, labels, items, extra=True), docs


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nothing"), [])
