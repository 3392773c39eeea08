"""Operators that cut down what they don't need before it is shuffled, told by their plans, and their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from namewake.operators import listings


def test_diverse_examples_limit_each_signature_first(spark):
    rows = spark.range(2000).select(F.concat(F.lit("busy"), (F.col("id") % 2).cast("string")).alias("label"), (F.col("id") % 4).alias("zone"), "id")
    found = listings.diverse_examples(rows, "label", "zone", ["id"], n=12)
    assert found._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") > 2  # of signatures as well as of groups
    assert [r.id for r in found.where("label = 'busy0'").orderBy("place").collect()] == list(range(0, 24, 2))


def test_linked_sends_no_table_through_the_driver(spark, monkeypatch):
    from namewake.operators import networks

    plans, kept = [], networks.stored

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(networks, "stored", watched)
    links = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, None)], "site long, key string")
    got = {r.site: r.operator for r in networks.linked(links.select("site"), links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_text_terms_cuts_a_text_before_it_is_shuffled(spark):
    from namewake.operators import names

    long = " ".join(f"w{i:04d}" for i in range(3000))
    texts = [(1, f"{long}. {long}"), (2, "The red fox' tail,  the fox' tail; red fox' tail to"), (3, None), (4, "red  sun"), (4, "sky, red moon"), (5, " .,")]
    found = names.text_terms(spark.createDataFrame(texts, "id long, text string"), ["the"], key="id", unigrams=3, bigrams=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")  # the plan is printed from its end
    got = sorted((r.id, r.words, r.place, r.term) for r in found.where("id <> 4").collect())
    assert got == [(1, 1, 1, "w0000"), (1, 1, 2, "w0001"), (1, 1, 3, "w0002"), (1, 2, 1, "w0000 w0001"), (1, 2, 2, "w0001 w0002"), (2, 1, 1, "red"), (2, 1, 2, "fox'"), (2, 1, 3, "tail"), (2, 2, 1, "red fox'"), (2, 2, 2, "fox' tail")]
    assert {r.term for r in found.where("id = 4 AND words = 1").collect()} >= {"red", "sky", "sun"}


def test_insight_cards_look_words_up_before_they_gather_them(spark, monkeypatch):
    import re

    from namewake.operators import insights

    plans, kept = [], insights.saved

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(insights, "saved", watched)
    names = [(label, zone, 1) for label in ("redredsun", "redmoon", "redsun", "sunred") for zone in ("com", "io")]
    adds = spark.createDataFrame(names, "label string, zone string, n int").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), "n"))
    pieces = spark.createDataFrame([("redredsun", ["red", "red", "sun"]), ("redmoon", ["red", "moon"]), ("redsun", ["red", "sun"]), ("sunred", ["sun", "red"])], "label string, pieces array<string>")
    words = spark.createDataFrame([("red",), ("sun",), ("moon",)], "entry string")
    got = insights.insight_cards(adds, pieces, words, F.lit("2024-01-02").cast("date")).collect()
    assert sorted((r.word, r.labels, r.names) for r in got) == [("red", 4, 8), ("sun", 3, 6)]
    assert any("raw" in p for p in plans) and not any(re.search(r"keys=\[label#\d+, word#\d+\]", p) for p in plans)  # every run of letters of every label
