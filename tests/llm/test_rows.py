"""Rows that repeat or lack an id: near-dedup as rows, samples bounded by rows."""

from pyspark.sql import functions as F

from tidewarden.llm import language, minhash, sampling

T = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(60))


def kept(spark, rows):
    df = spark.createDataFrame([(i, t, j) for j, (i, t) in enumerate(rows)], "doc_id long, text string, pos int").repartition(3)
    return sorted(((r["doc_id"], r["text"]) for r in minhash.dedup(df).collect()), key=str)


def test_one_of_equal_rows_stays(spark):
    assert kept(spark, [(1, T), (1, T), (None, T), (None, T)]) == [(1, T)]
    assert kept(spark, [(None, T), (None, T), (None, OTHER), (None, None), (2, "")]) == sorted(
        [(None, T), (None, OTHER), (None, None), (2, "")], key=str
    )


def test_a_clean_row_stays_beside_a_copy_with_its_id(spark):
    assert kept(spark, [(1, T), (3, OTHER), (3, T)]) == [(1, T), (3, OTHER)]
    assert kept(spark, [(5, T), (3, OTHER), (4, OTHER + " end"), (3, T)]) == [(3, OTHER), (3, T)]


def test_samples_are_bounded_by_rows(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.createDataFrame([(8, "ein Text", "de"), (9, None, "de")], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1), (9, 0), (10, 1)], "doc_id long, quality int")
    found = sampling.labelled(docs, labels, "quality", 100).collect()
    assert sorted((r["doc_id"], r["_label"]) for r in found) == [(7, 1), (8, 1), (9, 0)]
    assert len(sampling.labelled(docs, labels, "quality", 2).collect()) <= 2
    again = sampling.labelled(docs.repartition(5), labels, "quality", 100).collect()
    assert {r["text"] for r in again} == {r["text"] for r in found}


def test_language_samples_take_one_row_of_an_id(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(language, "train", lambda rows, codes, family_of: taken.append(sorted(codes.tolist())))
    docs = spark.range(500).select((F.col("id") % 40).alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, f"ein Satz {i}", "de") for i in range(90)], "doc_id long, text string, lang string"))
    language.fit(docs, per_language=30)
    assert taken == [["de"] * 30 + ["en"] * 30]
