"""Language ID over more languages than the given tables have."""

import random

import pyarrow as pa

from millrace.llm import langid


def test_every_language_is_learned(spark):
    """Of 80 languages, the rarer ones too are learned and told apart."""
    rng = random.Random(3)
    rows = []
    for k in range(80):
        vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(25)]
        rows += [(" ".join(rng.choices(vocabulary, k=60)), f"l{k:02}") for _ in range(12 if k < 40 else 9)]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)
    assert langid.train(df).langs == [f"l{k:02}" for k in range(80)]
    lang = {i: g for i, (_, g) in enumerate(rows)}
    held = [r for r in langid.identify(df).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert langid.identified(df).count() > 0.97 * len(rows)


def test_thousands_of_tags_are_solved_in_one_size(spark):
    """The solve keeps its size, whatever the number of languages, and each tag with a text is learned."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=8)), f"tag{i % 1500:04d}") for i in range(4500)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) > 1200
    assert model.weights.shape[1] <= 4 * langid.LANDMARKS and model.alpha.shape == (model.weights.shape[1], len(model.langs))
    names, scores = model.predict(pa.array([rows[0][1], "123"]))
    assert names[0] in model.langs and names[1] == "und" and 0 < scores[0] <= 1
