"""Copies go with the line dedup; the order that the mixing stage decides lasts to the last stage, whatever files lie between."""

from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline


def test_mixed_order_reaches_the_result(spark, tmp_path):
    rows = [(i, f"text {i} " + "word " * (i * 37 % 200), "en", f"s{i % 7 % 3}", 1) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, "t", "en", None, 1), (5, None, "en", "s1", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    mixed.write.option("maxRecordsPerFile", 30).parquet(f"{tmp_path}/mixed")
    files = sorted(str(p) for p in Path(tmp_path, "mixed").glob("part-*.parquet"))
    assert len(files) > 10
    schedule = [(r.doc_id, r.source) for f in files for r in spark.read.parquet(f).collect()]
    # the files once as they lie, once dealt out anew
    read = spark.read.parquet(f"{tmp_path}/mixed")
    for again in (read, read.repartition(5, F.xxhash64("text"))):
        out = corpus_pipeline.encode(spark, again, "").select("doc_id", "source", "slot", "in_block", "n_tokens").collect()
        assert [(r.doc_id, r.source) for r in sorted(out, key=lambda r: (r.slot, r.in_block))] == schedule
        assert len({(r.slot, r.in_block) for r in out}) == len(schedule) == 402


def test_copies_leave_no_empty_document(spark):
    a, b, c, x = (f"line {n} of six plain words" for n in "abcx")
    own = f"text {x} of its own\nand its second line here"
    rows = [(1, f"{a}\n{b}\n{x}"), (2, f"{a}\n{b}\n{x}"), (3, f"\n\n{a}\n{b}\n  "), (4, f"{c} once\n{b}\n{x}\n{c}\n{c}\n{c}\n{c}"), (5, ""), (6, None), (7, " \n\n "),
            (8, x), (9, x), (10, "a b\nc d"), (11, "a b\nc d"), (12, f"{own}\n{a}\n{b}"), (0, None), (0, "")]
    # the lines of 4 stand first in several places; a copy of it holds nothing of its own all the same
    rows += [(20, rows[3][1]), (21, rows[3][1]), (21, rows[3][1]), (None, rows[3][1]), (None, rows[0][1]), (None, f"{b}\n{x}\nno id, but a line"), (None, f"{own} b\n{c}"), (None, x)]
    docs = spark.createDataFrame([(k, t, "en", "s", -1, k) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int, _at long")
    got = corpus_pipeline.drop_repeated_passages(spark, docs, "")
    assert got.schema == docs.schema
    # two lines that occur again in the copies stay whole where they stand first
    first = f"{c} once\n{b}\n{x}\n{c}\n{c}\n{c}"
    want = [rows[0], (4, first), *rows[4:11], (12, own), *rows[12:14], (None, "no id, but a line"), (None, f"{own} b\n{c}"), (None, x)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r._at == r.doc_id for r in got.collect())
    assert corpus_pipeline.drop_repeated_passages(spark, docs.limit(0), "").count() == 0
