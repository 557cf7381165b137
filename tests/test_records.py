"""Components, businesses behind public records, and quotes against brute force."""

import random
import re

from growthlens.operators import copyq, entities
from growthlens.plans.components import components

RECORD = "record_id bigint, directory string, name string, phone string, address string, category string, url string, same_as array<string>"


def roots(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(150)] + [(2000, 2000 + i) for i in range(200)] + [(4000 - i, 5000) for i in range(50)]
    edges += [(7, 7), (9999, 9999), edges[0], edges[0][::-1]]
    made = spark.createDataFrame([*edges, (None, 1), (2, None)], "a bigint, b bigint")
    assert {r.id: r.root for r in components(made).collect()} == roots(edges)
    assert components(made.limit(0)).count() == 0


def test_records_of_one_business(spark):
    rows = [
        (1, "d1", "Acme Tiles", "+1 (555) 123-4567", "1 Main St", "Tiles", "https://d1.com/acme", None),
        (2, "d2", "ACME-TILES", None, " 1 main st", "tiles", "https://d2.com/acme", []),
        (3, "d3", "Tile Shop", "555 123 4567", "9 Oak Rd", "Tiles", None, ["https://d4.com/x/"]),
        (4, "d4", None, None, None, None, "https://d4.com/x", None),
        (5, "d1", "Lone", "12", "a", "b", None, None),
        (5, "d1", "Lone", "12", "a", "b", None, None),
        (6, "d1", "!!", "12", "a", "b", None, None),
        (7, "d2", None, "12", None, None, "", None),
        (None, "d9", "Lone", None, "zzz", None, None, None),
    ]
    records = spark.createDataFrame(rows, RECORD)
    found = {r.record_id: r.entity_id for r in entities.record_entities(records).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7}
    got = [tuple(r) for r in entities.entity_conflicts(records).select("entity_id", "records", "directories", "names", "phones", "addresses", "categories", "conflicts").collect()]
    # +1 555... and 555... are one number
    assert got == [(1, 4, 4, 2, 1, 2, 1, "name,address")]
    assert entities.entity_conflicts(records.limit(0)).count() == 0


def test_quotes_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["we", "do", "Not", "cut", "corners", "don’t", "ever,", "so-so"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    sources = [(i % 12, say(rng.randrange(0, 60))) for i in range(20)] + [(30, None), (31, ""), (None, "we do")]
    copies = [(i, rng.choice([*range(13), 30, 31, None]), " ".join(f"“{say(rng.randrange(0, 6))}” {rng.choice(words)}" for _ in range(4))) for i in range(60)]
    copies += [(70, 0, None), (71, 0, ""), (72, 0, 'no quote "'), (73, 0, '"..." "—"'), (74, 0, f'"{sources[0][1]}"'), (74, 0, f'"{sources[0][1]} x"')]
    plain = lambda t: " " + " ".join(re.findall(r"\w+", re.sub("[“”\"‘’']", "", t or "").lower())) + " "
    want = []
    for doc, source, text in copies:
        for no, q in enumerate(re.findall('[“"]([^“”"]+)[”"]', text or "")):
            said = [plain(t) for s, t in sources if s is not None and s == source]
            if plain(q).strip() and not any(plain(q) in t for t in said):
                want.append((doc, source, no, q))
    got = copyq.quote_traceability(
        spark.createDataFrame(copies, "doc_id int, source_id int, text string"), spark.createDataFrame(sources, "source_id int, text string")
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and 20 < len(want) < 220


def test_quotes_are_not_taken_apart(spark, monkeypatch):
    """A long quote and a source that everybody quotes: what is written and moved has one row per quote."""
    said = " ".join(f"w{i}" for i in range(900))
    copies = [(1, 1, f'"{said[5:2000]}"'), (2, 1, f'"{said[4:2000]}"')] + [(10 + i, 2, f'"w{i} w{i + 1 + i % 2}"') for i in range(12)]
    written = []
    monkeypatch.setattr(copyq, "QUOTE_GROUP", 3, raising=False)
    monkeypatch.setattr(copyq, "cut_lineage", lambda df, cut=copyq.cut_lineage: (df := cut(df), written.append(df.count()))[0])
    got = copyq.quote_traceability(
        spark.createDataFrame(copies, "doc_id int, source_id int, text string"), spark.createDataFrame([(1, said), (2, said)], "source_id int, text string")
    )
    assert sorted(r.doc_id for r in got.collect()) == [2, 11, 13, 15, 17, 19, 21] and sum(written) <= len(copies) + 1
