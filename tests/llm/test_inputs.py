"""Columns whose names clash with working or output columns, mark characters in texts, hot keys, empty tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from growthlens.llm import linechunks, mixing, quotes, toxicity


def test_any_character_may_stand_in_a_message(spark):
    odd = "﷐ one ﷑ two ﷒ three ﷒0﷒1﷒2"
    rows = [(1, odd), (2, f"> {odd}\n\nanswer ﷐"), (3, "> answer ﷐\n\n﷑"), (4, "﷐﷑﷒")]
    got = {r.message_id: r for r in quotes.link_quotes(spark.createDataFrame(rows, "message_id long, text string")).collect()}
    assert got[1].body == odd and got[2].body == "answer ﷐" and got[3].body == "﷑" and got[4].body == rows[3][1]
    assert (got[2].reply_to, got[3].reply_to, got[3].root) == (1, 2, 1)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.link_quotes(quotes.as_mail(none)).count() == 0


def test_toxicity_with_clashing_columns_and_one_key(spark):
    rows = [(i if i % 3 else 7, f"text {i} " + ("vile" if i % 4 == 0 else "kind"), "s", 5, "t") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int, _text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels, keep=docs.columns)
    assert got.columns == ["doc_id", "text", "_text", "score", "predicted"] and dict(got.dtypes)["score"] == "double" and got.count() == 200
    again = toxicity.score(docs, labels, keep=docs.columns, out=("p", "q"))
    assert again.columns == [*docs.columns, "p", "q"] and {r.score for r in again.collect()} == {"s"}
    assert toxicity.score(docs.limit(0), labels, keep=docs.columns).count() == 0


def test_stages_keep_clashing_columns(spark, tmp_path):
    shared = "a line of six words here\nand another line of these words"
    rows = [(i, f"own line {i}\n{shared}\nend {i}", "en", f"s{i % 3}", 9, *["x"] * 12) for i in range(30)]
    extra = ["_l", "_k", "_th", "_edge", "_kept", "_clean", "_gone", "_s", "_i", "_m", "score", "predicted"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    clean = linechunks.remove_repeated_passages(docs.withColumn("n_lines", F.lit("q")).withColumn("_doc", F.lit("d")))
    assert clean.columns == [*docs.columns, "_doc", "n_lines", "n_removed"]
    assert {(r.n_removed, r._l, r._clean, r._doc) for r in clean.collect()} == {(0, "x", "x", "d"), (2, "x", "x", "d")}
    mixed = mixing.mix(docs.withColumn("slot", F.lit("q")).withColumn("_doc", F.lit("d")).withColumn("_k", F.lit("y")), block_docs=4)
    assert mixed.columns == [*docs.columns, "_doc", "block_no", "slot", "in_block"] and mixed.count() == 30
    assert {(r._s, r._i, r._k, r._doc) for r in mixed.collect()} == {("x", "x", "y", "d")} and sorted(r.slot for r in mixed.collect())[0] == 0
    labels = f"{tmp_path}/labels.parquet"
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(labels)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert {c: t for c, t in docs.dtypes if c in extra} == dict.fromkeys(extra, "string")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert {tuple(r[c] for c in extra) for r in docs.collect()} == {("x",) * 12}
