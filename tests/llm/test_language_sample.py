"""The training sample of language ID over labels made of copies."""

from tastemill.llm import lang_id as L


def test_labels_of_copies_are_learned(spark):
    texts = {"de": "der die das und", "en": "the of and to", "es": "el la los y", "fr": "le la les et"}
    rows = [(t, k) for k, t in texts.items() for _ in range(500)]
    langs, got = L.sample(spark.createDataFrame(rows, "text string, lang string"), rows=4)
    assert langs == sorted(texts)
    assert sorted((r["lang"], r["text"]) for r in got.collect()) == sorted(texts.items())


def test_copies_do_not_fill_a_language(spark):
    rows = [("copied text", "en")] * 300 + [(f"own text {i}", "en") for i in range(9)] + [("texte", "fr"), (None, "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").where("text is not null")
    langs, got = L.sample(df, rows=20)
    assert langs == ["en", "fr"]
    assert sorted(r["text"] for r in got.collect()) == sorted({t for t, _ in rows if t})


def test_every_label_is_learned(spark):
    rows = [(f"w{i}x w{i}y text {k}", f"l{i:03d}") for i in range(230) for k in range(3)]
    model = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model["langs"] == sorted({lang for _, lang in rows}) and len(model["code"]) == 230
