"""Hard negatives, spelling variants and line dedup against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm import hard_negatives, line_dedup, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, keys string, id string, n long, word string, of string, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "l", "k", "i", 1, "w", "o", "k") for i, t in rows], DOCS)


# Hard negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (9, 64, 33), (40, 17, 100), (64, 64, 64), (0, 8, 20)])
def test_strassen(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-300, 300, (m, k)), rng.integers(-300, 300, (k, n))
    assert (hard_negatives.strassen(a, b) == a @ b).all() and (hard_negatives.strassen(a, b, leaf=1) == a @ b).all()
    wide = a.astype(object) * 10**30
    assert (hard_negatives.strassen(wide, b.astype(object)) == wide.dot(b.astype(object))).all()


def test_strassen_wraps_back():
    a, b = np.full((20, 20), 2**58), np.eye(20, dtype=np.int64) * 31
    assert (hard_negatives.strassen(a, b) == a * 31).all()  # sums of quarters leave 64 bits on the way


def test_heaps_merge_in_any_order():
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.randrange(50), rng.randrange(6)) for _ in range(600)]
    want = sorted(x for o in range(4) for x in sorted((r for r in rows if r[0] == o), key=lambda r: (-r[2], r[1]))[:5])
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        heaps = hard_negatives.Heaps(4, 5)
        for k in range(0, len(rows), 37):
            heaps.push(*np.array(rows[k : k + 37], dtype=np.int64).T)
        assert sorted(zip(heaps.owner.tolist(), heaps.ids.tolist(), heaps.score.tolist(), strict=True)) == want


def plain_negatives(rows, is_anchor, k=5):
    """``rows``: (id, label, list of integers)."""
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    own = {}
    for i, label, v in rows:
        if is_anchor(i):
            own[i] = min(own.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in own.items():
        scored = sorted((-clip(sum(x * y for x, y in itertools.zip_longest(v, w, fillvalue=0))), i, other) for i, other, w in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            hits = [(n, -t) for t, n, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, r + 1, n, -s, t) for r, (n, t) in enumerate(hits)]
    return sorted(out)


def test_hard_negatives(spark):
    rng = random.Random(5)
    data = []
    for i in range(700):
        v = [rng.choice([0.5, 1.0, 0.25, -0.25, 2.0]) for _ in range(6)]
        data.append((i, rng.choice([0, 0, 0, 1, 2, 3]), v))
    data += [(1000 + i, i % 4, [1.0, 0.5, 1.0, 0.5, 1.0, 0.5]) for i in range(400)]  # one vector that a third repeats
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0)
    ints = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in data]
    want = plain_negatives(ints, lambda i: i % 50 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_hard_negatives_edges(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST", 2)
    kind = "vec_id long, label int, embedding array<double>, id long, asks int, block string, windows int, score int, part int"
    rows = [
        (0, 1, [1.0, 2.0]), (0, 1, [1.0, 1.5]), (1, 1, [1.0]), (2, 2, [0.8, 0.1]), (3, None, [9.0]), (4, 2, None), (5, 2, [None, 1.0]), (6, 2, [float("nan")]),
        (7, 2, [float("inf")]), (None, 1, [1.0]), (8, 2, []), (9, 1, [3.0, 1.0, 4.0]), (9, 1, [3.0, 1.0, 4.0]), (10, 3, [2.4, 1.1]), (10, 3, [2.4, 1.1]), (11, 2, [-1.0, -2.0]), (20, 5, [1.0, 1.0]), (30, 1, [-9.0]),
    ]
    df = spark.createDataFrame([(*r, 1, 1, "b", 1, 1, 1) for r in rows], kind)
    good = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(good, lambda i: i % 10 == 0)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.hard_negatives(df, F.lit(None).cast("boolean")).collect() == []


def test_hard_negatives_of_wide_scores(spark):
    rows = [(i, i % 3, [float(10 ** (i % 13)), 3.0 * i, -(10.0 ** (i % 7))]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    ints = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows]
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 4 == 0).collect())) == plain_negatives(ints, lambda i: i % 4 == 0)


# Spelling variants


def apart(a, b):
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, noise=199):
    counts = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if own is None else own}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if noise and h % noise == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by = defaultdict(set)  # by every deletion of a code point, which is another way than signatures
    for w in words:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[x].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a, b in itertools.combinations(group, 2):
            if apart(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(map(repr, out))


def test_spelling_variants(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_variants([(r.doc_id, r.text) for r in d.collect()])
    assert sorted(repr(tuple(r)) for r in spelling.spelling_variants(d).collect()) == want and len(want) > 500


def made_up(seed, n):
    """Words and their variants, in counts that make chains of forms."""
    rng = random.Random(seed)
    text = []
    for _ in range(n):
        w, times = "".join(rng.choices("abcdeéÿÀxyz", k=rng.randrange(6, 11))), rng.choice([5, 30, 800])
        text += [w] * times
        for _ in range(rng.randrange(4)):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            w = w[:i] + (rng.choice("abcq") if kind else "") + w[i + (kind < 2) :]
            times = max(1, times // rng.choice([4, 5, 6]))
            text += [w] * times
    return " ".join(text)


@pytest.mark.parametrize("shared", [0, 64])
def test_spelling_chains(spark, monkeypatch, shared):
    monkeypatch.setattr(spelling, "SHARED", shared)  # 0: every signature that words share is split by starts and ends
    rows = [(k, made_up(k, 60)) for k in range(4)] + [(None, "Wordlike wordlikE " * 4 + "wordliké " * 40), (9, None), (9, ""), (9, "wordliked " * 90), (9, "wordliked " * 90), (10, "x" * 200_000 + " " + "a b " * 9)]
    want = plain_variants(rows)
    assert sorted(repr(tuple(r)) for r in spelling.spelling_variants(docs_of(spark, rows)).collect()) == want
    forms = {w: f for w, f, *_ in map(eval, want) if f}  # noqa: S307
    assert any(f in forms for f in forms.values())  # a chain of two
    assert spelling.spelling_variants(docs_of(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize(("first", "second"), [(1, 6), (1, 8), (2, 4), (3, 3)])
def test_signatures_meet(first, second):
    rng = random.Random(second)
    for _ in range(2000):
        a = "".join(rng.choices("abcdefgé", k=rng.randrange(6, 12)))
        i, kind = rng.randrange(len(a)), rng.randrange(3)
        b = a[:i] + (rng.choice("abcxyz") if kind else "") + a[i + (kind < 2) :]
        x, y = spelling.signatures_of([a, b], first, second)
        assert set(x[x == y]), (a, b)
    assert spelling.choices(1, 6) != spelling.choices(2, 3) and len(spelling.choices(1, 6)) == 15 and len(spelling.choices(2, 4)) == 8


def test_anagrams_meet_by_their_ends(spark):
    rng = random.Random(1)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(900)}
    words |= {w[:-1] + "x" for w in list(words)[:20]}
    v = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = spelling.near_pairs(v).select("a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a, b in itertools.combinations(sorted(words), 2) if apart(a, b))


# Line dedup

SPACE = " \t\n\v\f\r"


def plain_lines(rows, chars=40, least=5):
    held = defaultdict(list)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                held[k].append(i)
    keep = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(map(repr, out))


def edge_rows():
    common, wide = "This line of Forty characters and more is common", "é" * 40
    rows = [(i, f"{common}\r\nown {i} " + "x" * 40 + f"\n\t{common.upper()} \x0b") for i in range(7)]
    rows += [(20 + i, f"{wide}\n{'é' * 39}\n{common[:39]}") for i in range(5)] + [(30, ""), (30, None), (31, "\n\n"), (None, common), (None, None)]
    rows += [(40, f"a\n{'tie ' * 20}")] * 3 + [(41, "tie " * 20), (41, "Tie " * 20 + "\nz"), (50, "y" * 90_000 + "\n" + "z\n" * 20_000)]
    rows += [(None, "only rows without an id hold this line, five of them")] * 5
    return rows + [(60 + i, " " + "nbsp is no space that is stripped, so keys differ" + " " * (i % 2)) for i in range(9)]


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_line_dedup(spark, limit):
    for rows in (edge_rows(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], []):
        got = line_dedup.dedup_lines(docs_of(spark, rows), limit=limit, bits=16)
        assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
        assert sorted(repr((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest())) for r in got.collect()) == plain_lines(rows)


def test_lines_of_large_filters(spark, monkeypatch):
    """Filters of more segments than are sent are laid over each other; tasks give out several."""
    monkeypatch.setattr(line_dedup, "LEAST_SEGMENTS", 16)
    monkeypatch.setattr(line_dedup, "MOST_SEGMENTS", 4)
    monkeypatch.setattr(line_dedup, "HELD", 50)
    rng = random.Random(2)
    lines = ["".join(rng.choices("abcdef", k=60)) for _ in range(300)]
    rows = [(i, "\n".join(rng.choices(lines, k=12))) for i in range(400)]
    assert sorted(repr((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest())) for r in line_dedup.dedup_lines(docs_of(spark, rows).repartition(7)).collect()) == plain_lines(rows)


def test_only_suspects_are_hashed(spark):
    rows = [(i, "\n".join(f"line {i} {j} " + "x" * 40 for j in range(50))) for i in range(100)] + [(200 + i, "common " * 10) for i in range(6)]
    d = docs_of(spark, rows)
    suspects = line_dedup.Suspects(d, "text", 40)
    found = line_dedup.suspected(d.select("doc_id", "text"), suspects, 40).select(F.explode("keys").alias("key"), "doc_id").collect()
    assert {r.doc_id for r in found} >= set(range(200, 206)) and len(found) < 100


def test_dropping_keeps_columns(spark):
    d = docs_of(spark, edge_rows())
    out = line_dedup.drop_repeated_lines(d)
    assert out.schema == d.schema and out.count() == d.count() and out.where("text is null").count() == d.where("text is null").count()
