"""Personal data: spans by pattern, and terms that give a protected value away.

Emails, addresses, cards and phones are found by pattern. Then the corpus decides which terms disclose whom a value belongs to.
What is protected is the value's general form: the mail domain, the address block, the card's issuer, the phone's area. With
the form's information IC(e) = -log2(rows of e / N) and pointwise mutual information PMI(t; e) between term and form over whole texts,
IC(e) - PMI(t; e) = -log2(rows with both / rows of t) is what the term leaves untold. A term that leaves at most ``LEFT`` bits, with
``DOUBT`` standard errors of doubt, tells nearly as much as the value itself and is generalised like it wherever it stands.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ship_by_value

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Bits of a protected form's information that a disclosing term may leave untold, and standard errors by which its rate must
#: lie above that bound. A term of a single row, which leads to one text only, just meets the bound.
LEFT, DOUBT = 1.0, 1.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_AROUND_WORDS = ".,;:!?()[]\"'"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, without trying every start of a long word."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1  # nothing before this @ can be part of a later match
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` sorted; per kind leftmost matches that do not overlap."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def hash64(x: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(x)
    return h - (1 << 64) if h >= 1 << 63 else h


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """``(term, start, end)`` of the words that no span overlaps, in their order."""
    taken, k, end = sorted((a, b) for a, _, b in spans), 0, -1
    for m in _WORD.finditer(text):
        x, y = m.span()
        while k < len(taken) and taken[k][0] < y:
            end = max(end, taken[k][1])
            k += 1
        if end > x:
            continue
        word = m[0].lstrip(_AROUND_WORDS)
        x, word = y - len(word), word.rstrip(_AROUND_WORDS)
        term = word.lower()
        if len(term) >= 3:
            yield term, x, x + len(word)


def general(kind: int, value: str) -> str:
    """What a value is one of: mail domain, address block of the first two parts, first six card digits, phone number without its last six digits."""
    if kind == 0:
        return value.rpartition("@")[2].lower()
    if kind == 1:
        return ".".join(str(int(p)) for p in value.split(".")[:2])
    digits = "".join(_DIGITS.findall(value))
    return digits[:6] if kind == 2 else digits[:-6]


def term_set(text: str) -> set[int]:
    """Hashes of the terms of a text without spans."""
    return {hash64(t.encode()) for t in {w.strip(_AROUND_WORDS).lower() for w in set(_WORD.findall(text))} if len(t) >= 3}


_COUNTED = [("row_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("base", pa.string()),
            ("held", pa.list_(pa.int64())), ("t", pa.list_(pa.int64())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())),
            ("term", pa.int64()), ("df", pa.int64())]
_FOUND = ("row_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, "
          "held array<bigint>, t array<bigint>, a array<int>, b array<int>, term bigint, df bigint")  # fmt: skip
#: Distinct terms that a task counts before it hands them over.
FLUSH = 400_000


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of every text ``row_id, text, doc_id``; forms and places of the terms of a text with values; besides, in how many rows each term stands."""
    counts: Counter = Counter()
    schema = None

    def handed_over() -> pa.RecordBatch:
        cols = [pa.nulls(len(counts), f.type) for f in schema]
        cols[-3:-1] = [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    for batch in batches:
        schema = pa.schema([*_COUNTED, ("doc_id", batch.schema.field(2).type)])
        rows = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py() or ""
            spans = base_spans(t)
            named = listed(spans)
            held, places = None, (None, None, None)
            if spans:
                held = [*{hash64(f"{KINDS[k]}:{general(k, t[a:b])}".encode()) for a, k, b in spans}]
                known: dict[str, int] = {}
                found = [(known.get(w) or known.setdefault(w, hash64(w.encode())), a, b) for w, a, b in terms_of(t, spans)]
                places = tuple(map(list, zip(*found))) if found else ([], [], [])
                counts.update(set(places[0]))
            else:
                counts.update(term_set(t))
            per = Counter(k for _, k, _ in spans)
            rows.append((i, *[per[k] for k in range(4)], hashlib.sha256(named.encode()).hexdigest(), named, held, *places, None, None))
        if rows:
            yield pa.RecordBatch.from_arrays([*[pa.array(x, f[1]) for x, f in zip(zip(*rows), _COUNTED)], batch.column(2)], schema=schema)
        if len(counts) > FLUSH:
            yield handed_over()
    if counts:
        yield handed_over()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``e, t, co`` of rows ``held, t``: rows that hold both, summed up in the task."""
    both: Counter = Counter()

    def handed_over() -> pa.RecordBatch:
        cols = [*zip(*both), list(both.values())]
        both.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["e", "t", "co"])

    for batch in batches:
        for es, terms in zip(batch.column(0), batch.column(1)):
            terms = set(terms.as_py())
            for e in es.as_py():
                both.update((e, t) for t in terms)
                if len(both) > FLUSH:
                    yield handed_over()
    if both:
        yield handed_over()


#: Bits of the map that leaves out most words before the join with the disclosing terms; it loses none of them.
MAP_BITS = 1 << 23


def _marks(bits: bytes):
    """Where the terms stand whose bit is set, in texts without base spans: ``row_id, t, a, b``."""

    def asked(word: str) -> bool:
        term = word.strip(_AROUND_WORDS).lower()
        at = hash64(term.encode()) % MAP_BITS
        return len(term) >= 3 and bool(bits[at >> 3] >> (at & 7) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, known = [], {}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py() or ""
                words = set(_WORD.findall(t))
                known.update((w, asked(w)) for w in words if w not in known)
                if any(map(known.__getitem__, words)) and not base_spans(t):
                    rows += [(i, hash64(term.encode()), a, b) for term, a, b in terms_of(t, []) if asked(term)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["row_id", "t", "a", "b"])

    return run


def _bit_map(terms: DataFrame) -> bytes:
    """One bit per remainder of a term's hash; of a fixed size, whatever the number of terms."""
    bits = bytearray(MAP_BITS // 8)
    at = F.pmod("t", F.lit(MAP_BITS))
    packed = terms.groupBy(F.shiftright(at, 15).alias("k")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("m"))
    for r in packed.collect():
        bits[r["k"] * 4096 : (r["k"] + 1) * 4096] = r["m"]
    return bytes(bits)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the disclosing terms among the base spans, by start."""
    for batch in batches:
        out = []
        for base, extra in zip(batch.column("base").to_pylist(), batch.column("extra").to_pylist()):
            spans = [(int(a), KINDS.index(k), int(b), k) for k, a, b in (x.split(":") for x in base.split(",") if x)]
            spans += [(x["a"], len(KINDS), x["b"], "term") for x in extra or []]
            out.append(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(set(spans))))
        names = [n for n in batch.schema.names if n not in ("base", "extra")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, pa.string())], [*names, "spans"])


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans``: one row per row of ``docs``.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive), base kinds and disclosing ``term``s:
    every word of every text that is one, except within a base span. NULL texts count as empty: no
    spans. NULL keys and repeated rows are kept as they are. Counts are of rows, exact, and cover all of them, so copies of a
    text count as often as they stand there. Texts themselves are never shuffled. The terms of rows with a value are found with the value
    and looked up by term; the texts without one are read once more, for those terms alone that also stand outside.
    """
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = src.select(F.xxhash64("doc_id", "text").alias("row_id"), "text", "doc_id")
    kind = dict(src.dtypes)["doc_id"]
    found = cut_lineage(rows.mapInArrow(_find, f"{_FOUND}, doc_id {kind}"))
    made = found.filter("row_id IS NOT NULL")
    holding = made.filter("held IS NOT NULL")
    pairs = holding.select("held", "t").mapInArrow(_together, "e bigint, t bigint, co bigint")
    # the form that a term tells most of
    best = cut_lineage(pairs.groupBy("e", "t").agg(F.sum("co").alias("co")).groupBy("t").agg(F.max("co").alias("co")))
    rows_of = found.filter("term IS NOT NULL").select(F.col("term").alias("t"), "df").join(best.select("t"), "t", "left_semi")
    rows_of = rows_of.groupBy("t").agg(F.sum("df").alias("dt"))
    least = 2.0**-LEFT
    rate = F.col("co").cast("double") / F.col("dt")
    sure = (rate - least) * (rate - least) * F.col("dt") >= DOUBT * DOUBT * least * (1 - least)
    told = cut_lineage(best.join(rows_of, "t").filter((rate >= least) & sure).select("t", (F.col("dt") > F.col("co")).alias("outside")))
    within = holding.select("row_id", F.explode(F.arrays_zip("t", "a", "b")).alias("x")).select("row_id", "x.*")
    bits = _bit_map(told.filter("outside").select("t"))
    marks = within.join(told, "t", "left_semi").select("row_id", "a", "b")
    if any(bits):
        without = rows.select("row_id", "text").mapInArrow(_marks(bits), "row_id bigint, t bigint, a int, b int")
        marks = marks.unionByName(without.join(told.filter("outside"), "t", "left_semi").select("row_id", "a", "b"))
    extra = marks.groupBy("row_id").agg(F.collect_set(F.struct("a", "b")).alias("extra"))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    out = made.select("row_id", *names, "base").join(extra, "row_id", "left")
    ddl = f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return out.select(*names, "base", "extra").mapInArrow(_joined, ddl).withColumnRenamed("doc_id", key)


def redact(text: str, spans: str) -> str:
    """The text with every span generalised to its kind; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b in (x.split(":") for x in spans.split(",") if x):
        if int(a) >= at:
            out += [text[at : int(a)], f"[{kind}]"]
            at = int(b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text``: distinct rows with all spans generalised; NULL texts stay NULL."""
    spans = find_personal_data(docs, key, text).select(key, "base_sha256", "spans").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, sums, lists = (batch.column(i).to_pylist() for i in range(4))
            keep = [hashlib.sha256(listed(base_spans(t or "")).encode()).hexdigest() == s for t, s in zip(texts, sums)]
            made = [None if t is None else redact(t, s) for t, s in zip(texts, lists)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [key, "text"]).filter(pa.array(keep, pa.bool_()))
            del ids

    a, b = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text")), spans.withColumnRenamed(key, "_k2")
    j = a.join(b, a["_k"].eqNullSafe(b["_k2"])).select("_k", "_text", "base_sha256", "spans")
    return j.mapInArrow(run, f"`{key}` {dict(a.dtypes)['_k']}, text string").distinct()


ship_by_value(__name__)
