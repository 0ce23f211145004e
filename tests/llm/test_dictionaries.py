"""The dictionaries of problem 4 hold what the whole collection holds, however rare a language is in it."""

import numpy as np

from lexmill.llm import encoding


def test_dictionaries_count_all_texts(spark):
    rng = np.random.default_rng(5)
    russian = ["".join(rng.choice(list("абвгдежзиклмнопрстуфхцчшщыэюя"), 7)) for _ in range(300)]
    texts = [f"wir müssen über das Gerät sprechen {i % 50}" for i in range(8000)]
    for i, word in enumerate(russian):  # every word in two texts far apart
        for at in (13 * i + 1, 7900 - 13 * i):
            texts[at] += f"\nи в не {word} на что"
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    whole = encoding.train_dictionaries(texts)
    held = {w.lower() for w in whole["ru"].decode().split()}
    assert set(russian) <= held
    lost = [(10_000 + i, "и в не ".encode("koi8_r").decode("cp1251") + w.encode("koi8_r").decode("cp1251")) for i, w in enumerate(russian[:40])]
    both = rows.unionByName(spark.createDataFrame(lost, "id long, text string"))
    got = {r.id: r.restored for r in encoding.garbled(both).collect()}
    assert got == {10_000 + i: f"и в не {w}" for i, w in enumerate(russian[:40])}
    assert encoding.collection_dictionaries(rows) == whole
