"""The bucketed and bounded helpers against plain windows and brute force."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from growthlens.operators import answers, copyq, ops
from growthlens.plans import groups, timeline


def events(spark, n=400):
    rng = random.Random(5)
    # one key holds most rows
    data = [(i, 1 if rng.random() < 0.7 else rng.randint(2, 5), rng.randint(0, 300), rng.choice([None, 1, 2, 3])) for i in range(n)]
    return spark.createDataFrame(data, "id int, k int, t int, v int")


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_timeline_equals_plain_windows(spark):
    e = events(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    bucket = F.floor(F.col("t") / 20)
    same(timeline.previous(e, ["k"], ["t", "id"], bucket, {"pt": "t", "pv": "v"}), e.withColumn("pt", F.lag("t").over(w)).withColumn("pv", F.lag("v").over(w)))
    same(timeline.running_sum(e, ["k"], ["t", "id"], bucket, F.coalesce("v", F.lit(0)), "s"), e.withColumn("s", F.sum(F.coalesce("v", F.lit(0))).over(upto)))
    same(timeline.last_known(e, ["k"], ["t", "id"], bucket, "v", "lv"), e.withColumn("lv", F.last("v", True).over(upto)))
    g = Window.orderBy("t", "id")
    same(timeline.row_numbers(e, [], ["t", "id"], bucket, "n").withColumn("n", F.col("n").cast("int")), e.withColumn("n", F.row_number().over(g)))


def test_first_n_cuts_before_the_shuffle(spark):
    e = events(spark)
    plan = groups.first_n(e, ["k"], ["t", "id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    w = Window.partitionBy("k").orderBy("t", "id")
    same(groups.first_n(e, ["k"], ["t", "id"], 3), e.withColumn("r", F.row_number().over(w)).filter("r <= 3").drop("r"))
    same(groups.latest(e, ["k"], ["t", "id"]), e.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t"), F.desc("id")))).filter("r = 1").drop("r"))


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(120)] for _ in range(6)]
    docs = []
    for i in range(120):  # a third of the texts are near copies of one base
        words = list(base[0] if i % 3 == 0 else base[rng.randint(1, 5)])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"x{rng.randint(0, 10**6)}"
        docs.append((i, " ".join(words)))
    docs += [(200, docs[0][1].upper()), (201, "solo text")]
    got = {r.doc_id: (r.first_id, r.jaccard) for r in copyq.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    seen, firsts = set(), []
    for i, t in docs:
        if t.lower() not in seen:
            seen.add(t.lower())
            firsts.append((i, shingles(t)))
    want = {}
    for k, (i, s) in enumerate(firsts):
        close = [(j, len(s & z) / len(s | z)) for j, z in firsts[:k] if 100 * len(s & z) >= 80 * len(s | z)]
        if close:
            want[i] = min(close)
    assert got == want and len(want) > 20
    copies = Counter(t.lower() for _, t in docs)
    dup = {r.first_id: r.copies for r in copyq.exact_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert dup == {min(i for i, t in docs if t.lower() == k): n for k, n in copies.items() if n > 1}


def test_unverified_figures_by_distance(spark):
    far, near = f" {'x' * 299} ", f" {'y' * 298} "  # gaps of 301 and 300
    texts = [(1, f"Acme{far}$10"), (2, f"Acme{near}$20 and $20"), (3, "$30 acme"), (4, "Acmecorp $40"), (5, f"$50{far}Acme"), (6, "ACME costs $1,200.00")]
    df = spark.createDataFrame(texts, "id int, answer string")
    facts = spark.createDataFrame([("$1200",)], "figure string")
    got = sorted((r.id, r.figure) for r in answers.unverified_figures(df, ["Acme", " "], facts, ["id"]).collect())
    assert got == [(2, "$20"), (3, "$30")]
    spans = [(r.id, r.name, r.start, r.end) for r in answers.mention_spans(df.filter("id = 3"), ["Acme"], ["id"]).collect()]
    assert spans == [(3, "Acme", 4, 8)]


def test_positions(spark):
    a = spark.createDataFrame([("B then Acme, A", ["https://blog.acme.com/x"], None), ("Acme vs Acme", [], "x"), ("A, B", ["bad"], None)], "answer string, cited_urls array<string>, error string")
    r = answers.analyze(a, ["Acme"], ["A", "B"], ["acme.com"]).collect()
    assert [x.brand_position for x in r] == [2, 1, None]
    assert r[0].competitors_mentioned == ["B", "A"] and r[0].our_url_cited and not r[2].our_url_cited


def test_schedule_skips_taken_slots(spark):
    items = spark.createDataFrame([(f"c{i}", i, f"2020-01-{i + 1:02d}") for i in range(6)], "content_id string, content_no bigint, date_published string").withColumn("date_published", F.to_date("date_published"))
    taken = spark.createDataFrame([(0,), (3,), (4,)], "slot_index bigint")
    got = {r.content_id: r.day * 2 + r.slot for r in ops.backfill_schedule(items, taken).collect()}
    assert got == {"c0": 1, "c1": 2, "c2": 5, "c3": 6, "c4": 7, "c5": 8}


def test_copy_lines_rules(spark):
    text = "---\nskip: delve\n---\nintro robust\n## Caption\nWe delve.\n> delve\n#a #b\nstill copy?\n## Caption two\n```\nvital\n```\n## Assets\npivotal\n"
    d = spark.createDataFrame([("a", text), ("b", "---\nnever closed\ndelve"), ("c", "plain crucial line\r\n[x](http://y)")], "doc_id string, text string")
    lines = [(r.doc_id, r.line_no, r.line) for r in copyq.copy_lines(d).orderBy("doc_id", "line_no").collect()]
    assert lines == [("a", 5, "## Caption"), ("a", 6, "We delve."), ("a", 10, "## Caption two"), ("a", 12, "vital"), ("c", 1, "plain crucial line")]
    hits = sorted((r.doc_id, r.line_no, r.pattern) for r in copyq.lint_hits(copyq.copy_lines(d)).collect())
    assert hits == [("a", 6, "delve"), ("a", 12, "vital"), ("c", 1, "crucial")]
    q = copyq.quote_traceability(
        spark.createDataFrame([(1, 9, 'He said "we never cut any corners here" and "this was never said by them"')], "doc_id int, source_id int, text string"),
        spark.createDataFrame([(9, "Well, we  never cut any corners HERE, you know")], "source_id int, text string"),
    )
    assert [r.quote for r in q.collect()] == ["this was never said by them"]
    anon = copyq.anonymise(spark.createDataFrame([(1, "Jo Smith paid $12,345.67 and $7")], "doc_id int, text string"), ["Jo Smith"]).first().text
    assert anon == "[name] paid $12,000 and $7"


def test_first_n_beyond_the_group_limit(spark):
    e = spark.range(6000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    got = groups.first_n(e, ["k"], [F.desc("t")], 1500)
    assert got.count() == 3000 and got.agg(F.min("t")).first()[0] == 3000


def test_near_duplicates_without_words(spark):
    rows = [(1, "!!!"), (2, "???"), (3, "--- ..."), (4, ""), (5, None), (6, "one two"), (7, "One, two!")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = {r.doc_id: len(r.s) for r in copyq.shingle_sets(docs).collect()}
    assert sizes == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 1}
    assert [(r.doc_id, r.first_id, r.jaccard) for r in copyq.near_duplicates(docs).collect()] == [(7, 6, 1.0)]
