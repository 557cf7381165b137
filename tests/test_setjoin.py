"""Similarity joins against brute force: a template family, copies, ties, empty and equal sets, an empty table."""

import random
from fractions import Fraction

from growthlens.operators import copyq
from growthlens.plans import setjoin


def family(rng):
    """Sets of one family that are close to some members and far from others, and unlike ones."""
    sets = []
    for i in range(70):
        start = rng.randrange(60)
        sets.append({*range(start, start + 60)} - {rng.randrange(120) for _ in range(4)})
    sets += [{rng.randrange(400) for _ in range(rng.randrange(1, 30))} for _ in range(40)]
    sets += [set(sets[3]), set(sets[3]), {9999}, {9999}, set(), {1}, {1, 2, 3, 4, 5}, {1, 2, 3, 4}]
    return sets


def run(spark, job, sets, percent):
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id bigint, s array<bigint>").repartition(3)
    return {r.id: (r.other, r.both, r.either) for r in job(df, percent).collect()}


def share(a, b):
    return Fraction(len(a & b), len(a | b)) if a | b else Fraction(0)


def test_first_similar_is_exact(spark):
    sets = family(random.Random(5))
    for percent in (80, 55):
        want = {}
        for i, s in enumerate(sets):
            close = [j for j in range(i) if share(s, sets[j]) * 100 >= percent]
            if close:
                want[i] = (close[0], len(s & sets[close[0]]), len(s | sets[close[0]]))
        assert run(spark, setjoin.first_similar, sets, percent) == want and want


def test_best_similar_is_exact(spark):
    sets = family(random.Random(6))
    want = {}
    for i, s in enumerate(sets):
        close = [(-share(s, z), j) for j, z in enumerate(sets) if j != i and share(s, z) * 100 >= 60]
        if close:
            j = min(close)[1]
            want[i] = (j, len(s & sets[j]), len(s | sets[j]))
    assert run(spark, setjoin.best_similar, sets, 60) == want and want
    assert run(spark, setjoin.best_similar, [], 60) == {} == run(spark, setjoin.first_similar, [set()], 80)


def test_only_rare_elements_and_sets_of_pairs_are_moved(spark, monkeypatch):
    sets = [{*range(1000 * i, 1000 * i + 100)} for i in range(30)]
    sets.append({*range(3000, 3095)})
    cut, seen = setjoin.cut_lineage, []
    monkeypatch.setattr(setjoin, "cut_lineage", lambda df: (df := cut(df), seen.append((df.columns, df.count())))[0])
    assert run(spark, setjoin.first_similar, sets, 80) == {30: (3, 95, 100)}
    posted = [n for columns, n in seen if columns == ["x", "id", "n", "pos"]]
    moved = [n for columns, n in seen if columns == ["id", "s"]][1:]  # the first is the table of all sets
    assert posted == [30 * 21 + 20] and moved and max(moved) == 2


def test_shared_words_stay_within_a_template(spark):
    rows = [(1, "a", "One two THREE four five"), (2, "b", "one two three four five"), (3, "a", "one, two; three four Five!"), (4, "a", None), (5, None, "one two"),
            (6, None, "two one one"), (None, "a", "one two three four five"), (7, "a", "one two three four"), (7, "a", "zzz")]
    got = copyq.shared_words(spark.createDataFrame(rows, "page_id bigint, template string, text string")).collect()
    assert sorted((r.page_id, r.partner_id, r.shared_words, r.shared_share) for r in got) == [
        (1, 3, 5, 1.0), (3, 1, 5, 1.0), (5, 6, 2, 1.0), (6, 5, 2, 1.0), (7, 1, 4, 0.8)]


def test_best_similar_moves_the_sets_of_pairs_only(spark, monkeypatch):
    sets = [{*range(1000 * i, 1000 * i + 100)} for i in range(30)] + [{*range(3000, 3095)}]
    cut, seen = setjoin.cut_lineage, []
    monkeypatch.setattr(setjoin, "cut_lineage", lambda df: (df := cut(df), seen.append((df.columns, df.count())))[0])
    assert run(spark, setjoin.best_similar, sets, 80) == {3: (30, 95, 100), 30: (3, 95, 100)}
    assert [n for columns, n in seen if columns == ["id", "s"]] == [2]
