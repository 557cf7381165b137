"""Operators against brute force on small fixtures: NULLs, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from growthlens.llm import ann, bpe, fingerprints, jaccard, linechunks, mixing, neural, pii, quotes, toxicity
from growthlens.llm.catalog import TARGET_WEIGHTS, VOCABULARY
from growthlens.llm.common import connected_components

RNG = np.random.default_rng(5)
WORDS = [f"w{i}" for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n))


# ------------------------------------------------------------------ 1 quotes


def test_quotes_link_nested_levels(spark):
    rows = [
        (1, "Hello  there\n\nsecond point", "a"), (2, "On Monday X wrote:\n> hello there\n\nmy answer", "b"),
        (3, "> > Hello there\n> my ANSWER\n\nthird", "c"), (4, "> not said by anybody\n\nfourth", "d"), (5, None, "e"), (6, "", "f"),
        (7, "> fourth", "g"), (None, "> third", "h"), (8, "my answer", "i"), (9, "> my answer", "j"), (9, "zzz", "k"),
    ]
    got = {r.message_id: r for r in quotes.link_quotes(spark.createDataFrame(rows, "message_id long, text string, m string")).collect()}
    assert {k: (r.reply_to, r.root, r.depth, r.n_quoted, r.n_linked) for k, r in got.items()} == {
        1: (None, 1, 0, 0, 0), 2: (1, 1, 1, 1, 1), 3: (2, 1, 2, 2, 2), 4: (None, 4, 0, 1, 0), 5: (None, 5, 0, 0, 0), 6: (None, 6, 0, 0, 0),
        7: (4, 4, 1, 1, 1), 8: (None, 8, 0, 0, 0), 9: (2, 1, 2, 1, 1),
    }
    assert got[2].body == "my answer" and got[1].body == "Hello  there\n\nsecond point" and got[5].body == ""


def test_quotes_long_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i, f"turn number {i}") for i in range(70)], "turn long, k long, text string").withColumn("conv_id", F.lit(0))
    got = quotes.link_quotes(quotes.as_mail(chain.select("conv_id", "turn", "text"))).collect()
    assert all(r.root == 0 and r.depth == r.message_id for r in got) and len(got) == 70
    assert quotes.link_quotes(spark.createDataFrame([], "message_id long, text string")).count() == 0


# ------------------------------------------------------------------ 2 toxicity


def test_toxicity_finds_words_and_needs_labels(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(i, prose(40, rng) + (" vile insult " if i % 4 == 0 else " ") + prose(40, rng)) for i in range(400)]
    rows += [(None, "vile insult vile insult"), (1000, None), (1001, ""), (1001, "")]
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(400)] + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert [r.predicted for r in got if r.doc_id is None or r.doc_id >= 1000] == [1, 0, 0, 0]
    assert toxicity.score(docs([(1, "vile")]), labels.limit(0)).first().predicted == 0
    assert toxicity.score(docs([]), labels).count() == 0


# ------------------------------------------------------------------ 3 BPE


def test_bpe_equals_the_library_and_reuses_chunks(docs):
    rng = np.random.default_rng(2)
    shared = prose(3000, rng)
    texts = [None, "", " ", "a", "\n\n  x\t ", "<|endoftext|>", shared + "<|endoftext|>" + shared, "y" * 5000, " " * 3000, "é日本　語 " * 900,
             prose(700, rng) + shared + "  \n " * 400 + prose(9, rng), "12 '" + shared[1:] + "'s don't", " ".join(shared.split(" ")), shared, shared]
    plain = Tokenizer.from_file(VOCABULARY)
    got = sorted(bpe.encode(docs(list(enumerate(texts))), VOCABULARY, ["doc_id"]).collect())
    for r, t in zip(got, texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    e = bpe.ChunkEncoder(plain)
    e.encode(shared)
    first = e.encoded
    e.encode(prose(500, rng) + shared)
    assert e.reused >= first - 3 > 2
    assert bpe.encode(docs([]), VOCABULARY, ["doc_id"]).count() == 0


def test_bpe_decodes(spark, docs):
    ids = bpe.encode(docs([(1, "héllo\n  world"), (2, None)]), VOCABULARY, ["doc_id"])
    assert [r.text for r in bpe.decode_ids(ids, VOCABULARY, ["doc_id"]).orderBy("doc_id").collect()] == ["héllo\n  world", ""]


# ------------------------------------------------------------------ 4 Jaccard join


def classes_by_brute_force(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    name = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return sorted(((k, len(s), name[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def family(rng):
    base = [prose(6, rng) for _ in range(40)]
    rows = [(i, " ".join(s for s in base if rng.random() < 0.9)) for i in range(90)]
    rows += [(100 + i, prose(int(rng.integers(1, 90)), rng)) for i in range(60)]
    rows += [(200 + i, rows[i][1].replace("w1", "W1", 1)) for i in range(20)] + [(300, rows[0][1]), (300, rows[0][1]), (None, rows[0][1])]
    return [*rows, (400, None), (401, ""), (402, " \n\t"), (403, "Ab  cd"), (404, "ab cd"), (405, "ab ce"), (None, "alone and without any key at all"),
            (406, " a b"), (407, "a b"), (408, "É a b c d e"), (409, "é a b c d e"), (410, "z" * 200_000)]


def test_jaccard_join(docs):
    for seed in (1, 2):
        rows = family(np.random.default_rng(seed))
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(rows)).collect()), key=str)
        assert got == classes_by_brute_force(rows)
    assert jaccard.near_duplicates(docs([])).count() == 0


def test_roots_keep_only_texts_with_a_possible_partner(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 60)), i, n, n - int(rng.integers(0, n // 5 + 1))) for i in range(400) for n in [int(rng.integers(10, 400))]]
    rows += rows[:50] + [(1000, 1000 + i, 40 * 2**i, 40 * 2**i) for i in range(5)]

    def alike(x, y):
        return x[0] == y[0] and x[1] != y[1] and 100 * min(x[2], y[2]) >= 80 * max(x[2], y[2]) and 180 * min(x[3], y[3]) >= 80 * (x[2] + y[2])

    got = [tuple(r)[:4] for r in jaccard._with_partners(spark.createDataFrame(rows, "key long, id long, n int, rest int")).collect()]
    assert len(got) == len(set(got)) and {x for x in rows if any(alike(x, y) for y in rows)} <= set(got) < {x for x in rows if x[0] < 1000}


def test_bound_loses_no_pair():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 2**63, 8).astype(np.uint64)])) for _ in range(90)]
    n = np.array([len(s) for s in sets])
    found = {(min(a, b), max(a, b)) for x, y in jaccard.bounded_pairs([jaccard.point(s) for s in sets], n, np.arange(len(sets))) for a, b in zip(x, y)}
    for a in range(90):
        for b in range(a + 1, 90):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (n[a] + n[b] - both):
                assert (a, b) in found
                heat = np.zeros(1 << jaccard.HEAT_BITS, np.uint8)
                assert len(np.intersect1d(jaccard.in_order(sets[a], heat), jaccard.in_order(sets[b], heat)))


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 8), (3, None), (2, 3), (5, 4), (11, 9)], "a long, b long")
    assert {tuple(r) for r in connected_components(edges).collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8), (11, 8)}


# ------------------------------------------------------------------ 5 line chunks


def test_line_chunks_equal_brute_force(spark, docs):
    rng = np.random.default_rng(4)
    passage = "\n".join(prose(12, rng) for _ in range(14))
    rows = [(i, "\n".join([prose(8, rng) for _ in range(i % 5)] + [passage] + [prose(8, rng) for _ in range(3)])) for i in range(12)]
    rows += [(20, rows[3][1]), (20, rows[3][1]), (21, None), (22, ""), (23, "one line only of more than five words"), (24, "one line only of more than five words"),
             (None, passage), (25, "\n\n\n"), (26, "ends with the mark ﷐\n﷐ here\n" + passage), (27, "a " * 100_000 + "\nb c d e f g")]
    d = docs(rows)
    cut = {(r.doc_id, r.text): r._chunks for r in linechunks.chunked(d.select("doc_id", "text")).collect()}
    first, want = {}, []
    places = sorted({(k, t) for k, t in rows if k is not None and t is not None}, key=lambda x: x[0])
    for k, t in places:
        assert "\n".join(cut[k, t]) == t
        for p, c in enumerate(cut[k, t]):
            if "\n" in c and len(c.split()) >= 5:
                first.setdefault(c, (k, p))
    for k, t in rows:
        chunks = cut[k, t] or []
        kept = [c for p, c in enumerate(chunks) if k is None or first.get(c, (k, p)) == (k, p)]
        want.append((k, t if t is None else "\n".join(kept)))
    got = linechunks.remove_repeated_chunks(d)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == [*d.columns, "n_lines", "n_removed"] and sum(r.n_removed for r in got.collect()) > 50
    assert linechunks.remove_repeated_chunks(docs([])).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def passages_by_brute_force(rows):
    """Texts without repeated passages: every two neighbouring lines are looked up in all texts, and runs follow one earlier place."""
    places, gone, stays = defaultdict(list), defaultdict(set), defaultdict(set)
    texts = {(k, t): t.split("\n") for k, t in rows if k is not None and t is not None}
    for (k, t), lines in texts.items():
        for p in range(len(lines) - 1):
            places[lines[p], lines[p + 1]].append((k, p, t))
    firsts = {pair: min(at) for pair, at in places.items() if len(at) > 1}
    for (k, t), lines in texts.items():
        runs, last = [], None
        for p in range(len(lines) - 1):
            f = firsts.get((lines[p], lines[p + 1]))
            if f == (k, p, t):
                stays[k, t] |= {p, p + 1}
            now = None if f is None or f == (k, p, t) else (f[0], f[2], f[1] - p)
            if now and now == last:
                runs[-1].append(p + 1)
            elif now:
                # the line on which two runs meet belongs to the first
                runs.append([p + 1] if last else [p, p + 1])
            last = now
        for run in runs:
            if len(run) > 1 and sum(len(lines[p].split()) for p in run) >= 5:
                gone[k, t] |= {*run}
    return [(k, t if (k, t) not in texts else "\n".join(x for p, x in enumerate(texts[k, t]) if p not in gone[k, t] - stays[k, t])) for k, t in rows]


def test_passages_stand_at_one_earlier_place(docs):
    a, b, c, x, y = (f"line {n} of five words" for n in "abcxy")
    rows = [(1, f"{a}\n{b}\n{x}"), (2, f"{y}\n{b}\n{c}"), (3, f"{a}\n{b}\n{c}"), (4, f"{x}\n{y}\n{a}\n{b}\n{c}")]
    out = {r.doc_id: r.text for r in linechunks.remove_repeated_passages(docs(rows)).collect()}
    # no text holds a, b, c before 3: what two of them leave is no passage any more
    assert out == {1: rows[0][1], 2: rows[1][1], 3: c, 4: f"{x}\n{y}\n{c}"}


def test_runs_with_other_bytes_stay(docs):
    rows = [(1, "p q r s\nt u v w"), (2, "p q r s\nt u v w"), (3, "other words of\nthis text here")]
    d = docs(rows).select(F.col("doc_id").alias("k"), "text")
    runs = linechunks.repeated_runs(linechunks.line_pairs(d))
    assert [(r.k, r._a, r.n, r.k0, r.p) for r in linechunks.equal_bytes(runs, d).collect()] == [(2, 0, 1, 1, 0)]
    # as if the hashes of the third text were those of the first
    th = {r.k: r.th for r in d.select("k", F.xxhash64("text").alias("th")).collect()}
    feigned = runs.withColumn("k", F.lit(3).cast("bigint")).withColumn("th", F.lit(th[3]))
    assert linechunks.equal_bytes(feigned, d).count() == 0


def test_planted_passages_go_whole(docs):
    rng = np.random.default_rng(11)
    unlike = lambda n: [f"u{rng.integers(1 << 60)} {prose(6, rng)}" for _ in range(n)]
    rows, want, n_gone = [], {}, 0
    for n in range(2, 7):
        for i in range(6):
            passage = unlike(n)
            for copy in range(3):
                k, before, after = len(rows), unlike(int(rng.integers(0, 4))), unlike(int(rng.integers(0, 4)))
                rows.append((k, "\n".join([*before, *passage, *after])))
                want[k] = "\n".join([*before, *after]) if copy else rows[-1][1]
                n_gone += n * (copy > 0)
    got = linechunks.remove_repeated_passages(docs(rows)).collect()
    assert {r.doc_id: r.text for r in got} == want and sum(r.n_removed for r in got) == n_gone
    assert all(r.n_lines == dict(rows)[r.doc_id].count("\n") + 1 for r in got)


def test_passages_equal_brute_force(docs):
    rng = np.random.default_rng(12)
    few = ["", "one", "two words", "a line of six words here", "é ü\t ß", *[prose(4, rng) for _ in range(12)]]
    rows = [(i, "\n".join(rng.choice(few, rng.integers(1, 12)))) for i in range(60)]
    rows += [(70, rows[3][1]), (70, rows[3][1]), (70, "another text\nof one key"), (None, rows[4][1]), (71, None), (72, ""), (73, "\n\n\n"), (74, "x\n" * 3000),
             (80, "z z z z z\na a a a a"), (81, "z z z z z\na a a a a\nb b b b b"), (82, "a a a a a\nb b b b b"), (83, "q w\ne r"), (84, "q w\ne r"),
             (85, "i j\nk l\nm n"), (86, "i j\nk l\nm n")]
    got = linechunks.remove_repeated_passages(docs(rows))
    assert got.columns == [*docs([]).columns, "n_lines", "n_removed"]
    out = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(out, key=str) == sorted(passages_by_brute_force(rows), key=str)
    # the first two lines that occur again stay whole; a short pair stays, a longer run of short lines goes
    assert {k: t for k, t in out if k in range(80, 90)} == dict(rows[-7:]) | {81: "a a a a a\nb b b b b", 82: "", 86: ""}
    assert linechunks.remove_repeated_passages(docs([])).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ------------------------------------------------------------------ 6 LM scoring


def test_language_model(docs):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{'a' if i % 2 else 'b'}{x}" for x in rng.integers(0, 30, 60))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "Never seen É words"), (None, "a1 a2"), (5, "b3"), (5, "b3")]
    got = neural.score(docs(rows)).collect()
    counts, held = Counter(), lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    for k, t in rows:
        if not held(k):
            counts.update(tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = Counter((k, held(k), len(w := tokens(t)), sum(counts[x] > 0 for x in w), total,
                    round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w), 6)) for k, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    long_ = [r for r in got if r.n_tokens > 50]
    assert sum(r.score for r in long_) > sum(r.base_score for r in long_)
    assert neural.score(docs([])).count() == 0


def test_model_is_normalised():
    rng = np.random.default_rng(7)
    m = neural.Model(np.log(rng.dirichlet(np.ones(neural.CLASSES))))
    y = rng.integers(0, neural.CLASSES, 9000)
    m.fit(y, np.roll(y, 1), np.roll(y, 2))
    every = np.arange(neural.CLASSES)
    one, two = np.full_like(every, 3), np.full_like(every, 400)
    assert np.exp(m.log_probs(one, two, every, m.normalisers())).sum() == pytest.approx(1, abs=1e-4)


# ------------------------------------------------------------------ 7 personal data

TRICKY = [
    None, "", "a@b", "x.y+z@h-1.example.com, q@@r.s a@b@c.d", "1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.3.0004 0.0.0.0.0.0.0.0", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (555) 010-9999, +12, + 1 222, +49.30.123456789012345", "é😀 mail: ü.a@b.co.", "9" * 40_000 + " " + "1." * 5000, "a" * 40_000 + "@b.c", "@" * 3000, "+1((((((((((2",
    "5 5-5", "1.2.3.4@5.6.7.8", "a@-.-.", "4111111111111111", "١.2.3.4 ",
]


def test_base_spans_equal_the_patterns(docs):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    d = lambda s: re.sub(r"[^0-9]", "", s)
    fine = [lambda s: True, lambda s: all(len(p.lstrip("0")) < 4 and int(p[-9:]) <= 255 for p in s.split(".")), lambda s: 12 <= len(d(s)) <= 19 and pii.luhn(d(s)), lambda s: 9 <= len(d(s)) <= 15]
    texts = [t for t in TRICKY if len(t or "") < 10_000]
    got = sorted(pii.find_personal_data(docs(list(enumerate(TRICKY)))).collect())
    assert len(got) == len(TRICKY)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TRICKY):
        if t in texts:
            spans = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t or "") if fine[k](m[0]))
            assert by[i].base_sha256 == hashlib.sha256(pii.listed(spans).encode()).hexdigest(), t


def test_disclosing_terms(docs):
    rng = np.random.default_rng(8)
    rows = [(i, f"{prose(30, rng)} zorglub writes from boss@corp.example.com today {prose(30, rng)}") for i in range(6)]
    rows += [(10 + i, f"{prose(30, rng)} today {prose(30, rng)}") for i in range(40)] + [(60, rows[0][1]), (60, rows[0][1]), (None, "x@y.zz")]
    got = pii.find_personal_data(docs(rows)).collect()
    assert len(got) == len(rows)
    r = next(r for r in got if r.doc_id == 3)
    text = dict(rows)[3]
    terms = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",")) if k == "term"}
    assert "zorglub" in terms and "today" not in terms and "email:" in r.spans
    clean = {x.doc_id: x.text for x in pii.sanitise(docs(rows)).collect()}
    assert "boss@" not in clean[3] and "zorglub" not in clean[3] and clean[12] == dict(rows)[12]
    assert pii.find_personal_data(docs([])).count() == 0


def disclosed_by_brute_force(rows):
    """Terms whose pointwise mutual information with a general form leaves at most a bit of it, by one standard error."""
    words = lambda t: {w for w, _, _ in pii.terms_of(t or "", pii.base_spans(t or ""))}
    forms = lambda t: {(k, pii.general(k, (t or "")[a:b])) for a, k, b in pii.base_spans(t or "")}
    texts = [(words(t), forms(t)) for _, t in rows]
    n, of_t, of_e = len(texts), Counter(w for ws, _ in texts for w in ws), Counter(e for _, es in texts for e in es)
    both, told = Counter((w, e) for ws, es in texts for w in ws for e in es), set()
    for (w, e), co in both.items():
        pmi, ic = math.log2(co * n / (of_t[w] * of_e[e])), math.log2(n / of_e[e])
        if ic - pmi <= 1 and (2 * co - of_t[w]) ** 2 >= of_t[w]:
            told.add(w)
    return told


def test_general_forms():
    values = ["x@Mail.Example.com", "010.2.3.4", "4111 1111-1111 1111", "+1 (555) 010-9999"]
    assert [pii.general(k, v) for k, v in enumerate(values)] == ["mail.example.com", "10.2", "411111", "15550"]


def test_disclosing_terms_go_wherever_they_stand(docs):
    rng = np.random.default_rng(21)
    far = lambda: prose(40, rng)
    rows = [(i, f"Zorglub, {far()} boss{i}@corp.example.com {far()} (zorglub) {far()} zorglub") for i in range(30)]
    rows += [(100 + i, f"{far()} today ZORGLUB\tsays {far()}") for i in range(2)] + [(200 + i, f"{far()} today says {far()}") for i in range(200)]
    rows += [(500, "rare@x.example.org quux one"), (501, "rare@x.example.org quux two"), (502, "quux three"), (503, "quux four")]
    rows += [(510, f"alone@z.example.org xyzzy {far()}"), (511, f"+1 (555) 010-9999 and 10.2.3.4 {far()} plugh"), (512, f"10.2.7.7 plugh {far()}")]
    rows += [(520, rows[3][1])] * 3 + [(521, None), (522, ""), (None, "none@q.example.org nokey"), (None, "ny")]
    told = disclosed_by_brute_force(rows)
    assert {"zorglub", "xyzzy", "plugh", "nokey"} <= told and not {"quux", "today", "says"} & told
    got, by = pii.find_personal_data(docs(rows)).collect(), dict(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            text = by[r.doc_id] or ""
            spans = [(int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"]
            assert spans == sorted((a, b) for w, a, b in pii.terms_of(text, pii.base_spans(text)) if w in told)
    assert sum("term:" in r.spans for r in got if r.doc_id in (100, 101)) == 2


# ------------------------------------------------------------------ 8 mixing


def test_pfair_stays_within_a_block(docs):
    counts = {"a": 700, "b": 300, "c": 90, None: 17}
    rows = [(i, None, s) for s, n in counts.items() for i in range(n)] + [(None, "t", "a"), (3, None, "a")]
    got = mixing.mix(docs(rows), {"a": 5, "b": 3, "c": 1}, block_docs=4, period=97)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    out = got.orderBy("slot", "in_block").collect()
    assert len(out) == len(rows) and len({(r.slot, r.in_block) for r in out}) == len(rows)
    assert sorted(map(str, [(r.doc_id, r.source) for r in out])) == sorted(map(str, [(i, s) for i, _, s in rows]))
    order = [s for s, _ in sorted({(r.source, r.slot) for r in out}, key=lambda x: x[1])]
    assert sorted({r.slot for r in out}) == list(range(len(order)))
    blocks = {"=a": 176, "=b": 75, "=c": 23, "null": 5}
    plan = mixing.phases(blocks, {"=a": 5, "=b": 3, "=c": 1, "null": 1}, 97)
    for phase in {p["phase"] for p in plan}:
        own = [p for p in plan if p["phase"] == phase]
        start, end = own[0]["start"], min([p["start"] for p in plan if p["phase"] == phase + 1], default=len(order))
        for p in own:
            name = None if p["source"] == "null" else p["source"][1:]
            seen = 0
            for t in range(start, end):
                seen += order[t] == name
                assert abs(seen - (t + 1 - start) * p["share"] / p["period"]) < 1
    assert mixing.mix(docs([])).count() == 0


def off_target(blocks, weights, period):
    """Largest distance of a source from its own target weight, in blocks, over all slots of all phases."""
    plan, left, worst, end = mixing.phases(blocks, weights, period), dict(blocks), 0, 0
    for phase in range(plan[-1]["phase"] + 1):
        own = [p for p in plan if p["phase"] == phase]
        until = min([p["start"] for p in plan if p["phase"] == phase + 1], default=sum(blocks.values()))
        total, slot_of = sum(Fraction(str(weights[p["source"]])) for p in own), {}
        for p in own:
            for n in range(left[p["source"]]):
                slot = p["start"] + n // p["share"] * p["period"] + (p["slots"][n % p["share"]] if n % p["share"] < len(p["slots"]) else until)
                if slot >= until:
                    break
                assert slot not in slot_of
                slot_of[slot] = p["source"]
        assert sorted(slot_of) == list(range(own[0]["start"], until)) and own[0]["start"] == end
        seen, end = Counter(), until
        for t, slot in enumerate(sorted(slot_of), 1):
            seen[slot_of[slot]] += 1
            worst = max(worst, *(abs(seen[p["source"]] - t * Fraction(str(weights[p["source"]])) / total) for p in own))
        left = {s: n - seen[s] for s, n in left.items()}
    assert not any(left.values())
    return worst


def test_pfair_keeps_the_given_weights(docs):
    assert off_target({"a": 2000, "b": 2000, "c": 2100}, {"a": 1, "b": 1, "c": 1}, 1000) < 1
    assert off_target({"a": 5000, "b": 4000, "c": 5}, {"a": 0.5995, "b": 0.4, "c": 0.0005}, 1000) < 1
    assert off_target({"a": 900, "b": 1500, "c": 1300, "d": 40}, {"a": 0.123456789, "b": 0.31, "c": 1 / 3, "d": 0.01}, 1000) < 1
    assert off_target({f"s{i}": 150 + i for i in range(20)}, {f"s{i}": 20 - i for i in range(20)}, 1000) < 1
    # weights whose least common period is beyond 64 bits
    rows = [(i, None, "abc"[i % 3]) for i in range(300)]
    out = mixing.mix(docs(rows), {"a": 0.1234567890123457, "b": 1e-9, "c": 12.000000000000002}, block_docs=4).collect()
    assert len({(r.slot, r.in_block) for r in out}) == 300 and {r.slot for r in out} == set(range(75))


def test_registered_weights_are_unequal():
    assert len(set(TARGET_WEIGHTS.values())) > 1


# ------------------------------------------------------------------ 9 fingerprints


def test_fingerprints(docs):
    rng = np.random.default_rng(9)
    rows = [(7 * i, prose(int(rng.integers(1, 200)), rng)) for i in range(60)] + [(1, None), (2, ""), (3, "é😀x"), (15, prose(3000, rng)), (None, "no key")]
    rows += [(700, rows[0][1]), (701, rows[0][1])]
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs(rows)).collect()}
    order = sorted(((k, t or "") for k, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    for (k, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[k]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.fingerprint(t))
        assert r.edited_fingerprint == fingerprints.fingerprint(edited) and 0 <= r.near_edited <= 1
    assert got[700].near_next == 1.0 and got[700].fingerprint == got[701].fingerprint and got[15].near_edited > 0.2 > got[15].near_next
    a, b = prose(2000, rng), prose(40, rng)
    whole = fingerprints.merge(fingerprints.fingerprint(a), fingerprints.fingerprint(b))
    assert fingerprints.containment(fingerprints.fingerprint(b), whole) == 1.0
    assert fingerprints.fingerprints(docs([])).count() == 0 and fingerprints.fingerprints(docs([(1, "abc")])).first().near_next == 1.0


# ------------------------------------------------------------------ 10 neighbours


def test_nearest_equals_brute_force(spark):
    x = RNG.normal(size=(400, 12)).astype(np.float32)
    x[300:360] = x[0]
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(450, None, "z"), (500, [0.0] * 12, "z"), (550, [float("nan")] * 12, "z"), (600, [None] * 12, "z"),
                                                           (None, [1.0] * 12, "z"), (650, [1.0, 2.0], "z"), (0, x[0].tolist(), "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, raw string")
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d = x.astype(np.float64)
    hit = total = 0
    assert sorted(got) == list(range(0, 400, 50))
    for q, found in got.items():
        s = ann.cosines(d[q], d)
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -s))[:5]
        hit += len({i for i, _ in found} & set(best.tolist()))
        total += 5
        assert len(found) == 5 and all(abs(s[i] - v) < 1e-12 for i, v in found) and found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hit >= 0.9 * total and [i for i, _ in got[0]] == [300, 301, 302, 303, 304]
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.filter("vec_id IN (50, 51)")).collect()[0].vec_id == 51


def test_pieces_of_odd_spaces_and_a_full_cache(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = bpe.ChunkEncoder(Tokenizer.from_file(path)), Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    texts = ["", " ", " \n", "\n\nx", "  lead", "a \n b\n\nc  d \n", "a\tb c d\n", "w \x1c z\x85 \nq", "x" * 5000 + " y", "one two three four five six seven " * 200]
    for t in texts * 2:
        assert encoder.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    assert len(encoder.words) <= 16


def test_merges_of_many_words_equal_the_library():
    """New words of a batch are merged together in arrays; the rest goes through the library."""
    rng = np.random.default_rng(12)
    parts = [*"aabcde\u00e9 \u0416\u0436\u03a9  \n\n\t'1\u00b2\u0663_-.,!\u4e2d\u0085\x1c\u0301\u0378\0^]-\\[", "'s", "'ll", "<|endoftext|>", " the", "ing", "<|"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, n)))) for n in [4, 40, 4000] * 60] + ["a%sb 1%s2 !%s? 's%s x" % ((chr(c),) * 4) for c in range(0x560)]
    texts += ["z" * 400 + " " + "ab" * 40 + " q", " " + "x" * 47 + " " + "y" * 48, "one two"]
    encoder, plain = bpe.ChunkEncoder(Tokenizer.from_file(VOCABULARY)), Tokenizer.from_file(VOCABULARY)
    for t, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids
    words = [" " + "".join(rng.choice([*"etaoinshr"], int(rng.integers(1, 30)))) for _ in range(3000)]
    got = encoder.merges.encode([*words, "\u4e2d", " <|endoftext|>", " a "])
    assert set(got) == set(words)
    assert all(np.frombuffer(got[w], np.int32).tolist() == plain.encode(w, add_special_tokens=False).ids for w in words)
