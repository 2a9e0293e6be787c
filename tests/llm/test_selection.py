import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from tidemill.llm import mixing, resample, shared, spelling

DOCS = "doc_id long, text string, lang string, source string, size int, row int, at string, word string, n long, score double, rank string, key int"
WORDS = "alpha beta gamma delta river stone cloud ember forest meadow signal harbor lantern copper violet thunder winter orchid été naïve Zebra 12".split()
EDGES = [None, "", "a", "\n\n \t", "Word", "same words here again", "same words here again", "12 34 x"]


def prose(n, seed, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "s", "ing", "ed"]) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, "x", "y", 3, 0.5, "z", 4) for i, t, s in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Sums in an order, as several operators use them.


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b", "é"]), r.randint(0, 3), i) for i in range(500)] + [("hot", 1, 1000 + i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v int, i long")
    from pyspark.sql import functions as F

    got = {x.i: x.b for x in shared.running(df, [F.col("k").asc_nulls_last(), F.col("i")], F.col("v"), "b").collect()}
    want, total = {}, 0
    for k, v, i in sorted(rows, key=lambda x: (x[0] is None, (x[0] or "").encode(), x[2])):
        want[i], total = total, total + v
    assert got == want
    assert shared.running(df.where("false"), [F.col("i")], F.col("v"), "b").count() == 0


def test_scopes_free_only_their_own(spark):
    with shared.Scope() as one:
        a = shared.cut(spark.range(5))
    with shared.Scope() as two:
        b = shared.cut(spark.range(7))
    loose = shared.cut(spark.range(3))
    two.release()
    assert a.count() == 5 and loose.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|FileNotFound|does not exist"):
        b.count()
    one.release()
    assert loose.count() == 3


# Mixing.


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """The reshare as it is said: what is above a cap goes to the others by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), sum(sizes.values())
    while free:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
        free -= over
    return out


def mixed(seed=0):
    r = random.Random(seed)
    rows = [(i, t, "edge") for i, t in enumerate(EDGES)]
    for i in range(300):
        source = r.choice(["a"] * 8 + ["b", "c", "é", None, "tiny"])
        rows.append((100 + i, prose(r.randint(0, 60), i), source))
    rows += [(900, prose(40, 3), "b")] * 3 + [(None, prose(30, 4), "c"), (901, prose(9000, 5), "d")]
    return rows


def test_mixing_takes_each_target(spark):
    rows = mixed()
    got = mixing.taken(table(spark, rows)).collect()
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    target = plain_targets(sizes)
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    words = Counter()
    for i, t, s in rows:
        r = by_id[i].pop()
        assert r.size == size(t) and r.source_size == sizes[s] and math.isclose(r.target, target[s], abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        words[s] += r.taken
    assert all(abs(words[s] - target[s]) <= 0.5 for s in sizes)
    again = mixing.taken(table(spark, random.Random(3).sample(rows, len(rows))).repartition(5)).collect()
    assert sorted(again, key=str) == sorted(got, key=str)


def test_schedule_keeps_shares_in_every_stretch(spark):
    schedule, rows, sources = mixing.mix(table(spark, mixed(1)), block=16)
    parts = schedule.collect()
    take = {r["rank"]: r["take"] for r in sources.collect()}
    total = sum(take.values())
    at = {}
    for p in parts:
        assert at.setdefault(p.position, (p["rank"], p.number)) == (p["rank"], p.number)
    slots = sum(-(-n // 16) for n in take.values())
    order = [at[i][0] for i in sorted(at)]
    assert len(order) == slots and len(set(at.values())) == slots
    # The source of slot i by hand, in exact arithmetic; blocks without a slot come last.
    edges = list(itertools.accumulate([0, *(take[k] for k in sorted(take))]))
    seen, want = Counter(), {}
    for i in range(slots):
        x = float(i * mixing.GOLDEN % 1) * total
        s = next(k for k, (a, b) in enumerate(zip(edges, edges[1:])) if a <= x < b)
        if seen[s] < -(-take[s] // 16):
            want[i] = (s, seen[s])
        seen[s] += 1
    assert {i: v for i, v in at.items() if i < slots} == want
    assert len(at) - len(want) <= 3 * len(take)
    for n in (len(order) // 4, len(order) // 2):
        have = Counter(order[:n])
        assert all(abs(have[s] - n * take[s] / total) < 8 for s in take)
    # A block's pieces make up its words, and no word of a document's turn is taken twice.
    filled, spans = Counter(), defaultdict(list)
    for p in parts:
        filled[p["rank"], p.number] += p.words
        spans[p.row, p.turn].append((p["from"], p["from"] + p.words))
    assert all(n == min(16, take[s] - 16 * k) for (s, k), n in filled.items())
    assert all(a[1] <= b[0] for x in spans.values() for a, b in itertools.pairwise(sorted(x)))


def test_mixing_without_words(spark):
    assert mixing.taken(table(spark, [])).count() == 0
    got = mixing.taken(table(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


def test_golden_points_are_exact_enough(spark):
    from pyspark.sql import functions as F

    ids = [0, 1, 65535, 65536, 10**6 + 7, 2**36 - 1]
    got = [r.x for r in spark.createDataFrame([(i,) for i in ids], "i long").select(mixing.point(F.col("i")).alias("x")).collect()]
    assert np.allclose(got, [float(i * mixing.GOLDEN % 1) for i in ids], atol=1e-9, rtol=0)


# Spelling.


def plain_words(rows):
    n = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    out, form = {}, {}
    for w in n:
        near = [x for x in n if x != w and one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [len(near)]
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n[w], out[w][0], n.get(form[w]))
    return out


def test_spelling_against_brute_force(spark):
    r = random.Random(2)
    base = ["hello", "hallo", "hellos", "hhello", "ccccc", "cccccc", "ccccccc", "abcde", "xabcde", "abcdex", "naïveté", "÷×÷×÷", "bread", "breed", "breads", "broads"]
    rows = [(i, t, "s") for i, t in enumerate(EDGES)]
    for i in range(160):
        chosen = [w for k, w in enumerate(base) for _ in range(r.randint(0, k % 5 + 1))]
        noisy = [w[:j] + r.choice("aeo") + w[j + 1 :] for w in r.choices(base, k=3) for j in [r.randrange(len(w))]]
        r.shuffle(chosen)
        rows.append((50 + i, r.choice([" ", "-", "1"]).join(x.upper() if r.random() < 0.2 and x.isascii() else x for x in chosen + noisy), "s"))
    rows += [(None, "chain chain chain lengthy " * 40, "s"), (7000, "word" * 5000 + " chainn" * 9, "s"), (60, rows[-1][1], "s"), (60, rows[-1][1], "s")]
    n = plain_words(rows)
    assert any(len(w) > 5 for w in n) and len(n) > 60
    got = {r.word: tuple(r) for r in spelling.variants(table(spark, rows)).collect()}
    assert got == plain_variants(n)
    assert {r.word: tuple(r) for r in spelling.variants(table(spark, rows).repartition(7)).collect()} == got
    assert any(v[1] is not None and v[2] != v[1] for v in got.values())  # a chain of forms


def test_spelling_drops_letters_as_the_hash_says(spark):
    rows = [(i, "elephants and violets", "s") for i in range(2000)]
    n = plain_words(rows)
    assert len(n) > 6 and {r.word: r.n for r in spelling.vocabulary(table(spark, rows)).collect()} == n


def test_spelling_shared_keys_are_single(spark):
    r = random.Random(4)
    words = {"".join(r.choices("ab", k=r.randint(5, 7))) for _ in range(120)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    pairs = [(x.word, x.other) for x in spelling.near(df).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if a != b and one_edit(a, b))


def test_spelling_roots_and_emptiness(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("x", "w3")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {f"w{i}": "w40" for i in range(40)} | {"x": "w40"}
    assert spelling.variants(table(spark, [])).count() == 0
    assert spelling.variants(table(spark, [(1, None, "s"), (2, "ab", "s")])).count() == 0


def test_spelling_broadcasts_nothing(spark, monkeypatch):
    """Small files of many words: no join sends them, or their exploded keys, through the driver."""
    plans, cut = [], spelling.cut

    def watched(df):
        df.collect()  # so that the plan is the one that ran
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(spelling, "cut", watched)
    rows = [(i, "bread breed breads broads bread breads lengthy", "s") for i in range(300)]
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) == 10 << 20
    found = spelling.variants(table(spark, rows))
    assert {r.word: r.root for r in found.collect()}["broads"] == "breads"
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    joins = [p for p in plans if "Join" in p]
    assert len(joins) >= 3 and all("Final Plan" in p and "SortMergeJoin" in p and "Broadcast" not in p for p in joins)


# Resampling.


def plain_features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return len(w), [crc32(f.encode()) % 10000 for f in w + [" ".join(x) for x in itertools.pairwise(w)]]


def plain_resample(rows, target):
    s, t = (Counter(b for x in texts for b in plain_features(x)[1]) for texts in ([x[1] for x in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out, fit = [], []
    for k, (i, text, _) in enumerate(rows):
        words, f = plain_features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if words >= 20:
            fit.append((-score, i is None, i or 0, len(f), weight, k))
    for rank, x in enumerate(sorted(fit)[: 25 * len(fit) // 100], 1):
        out[x[-1]][4] = rank
    return sorted(map(str, map(tuple, out)))


def test_resampling_against_brute_force(spark):
    rows = [(i, t, "s") for i, t in enumerate(EDGES)]
    rows += [(100 + i, prose(random.Random(i).randint(1, 80), i), "s") for i in range(400)]
    rows += [(-5, prose(30, 1), "s"), (None, prose(50, 2), "s"), (None, prose(25, 8), "s"), (100, prose(60, 0), "s"), (77, "x" * 300 + " " + prose(4000, 9), "s")]
    rows += [(5000, prose(33, 6), "s")] * 120  # one key for a fifth of the rows
    target = [prose(30, 1000 + i, WORDS[:6]) for i in range(40)] + [None, "", "  "]
    want = plain_resample(rows, target)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert sorted(str(tuple(r)) for r in resample.resample(table(spark, rows), goal).collect()) == want
    assert sorted(str(tuple(r)) for r in resample.resample(table(spark, rows).repartition(9), goal).collect()) == want
    empty = goal.where("false")
    assert sorted(str(tuple(r)) for r in resample.resample(table(spark, rows[:40]), empty).collect()) == plain_resample(rows[:40], [])
    assert resample.resample(table(spark, []), goal).count() == 0


def test_resampling_draws_toward_the_target(spark):
    rows = [(i, prose(60, i, WORDS[:6] if i % 4 == 0 else WORDS[6:]), "s") for i in range(800)]
    goal = spark.createDataFrame([(i, prose(30, 5000 + i, WORDS[:6])) for i in range(50)], "item_id long, text string")
    drawn = [r.doc_id for r in resample.resample(table(spark, rows), goal).collect() if r["rank"]]
    assert len(drawn) == 200 and sum(i % 4 == 0 for i in drawn) > 120


def test_radix_selection_finds_any_place(spark):
    from pyspark.sql import functions as F

    r = random.Random(7)
    keys = [(r.choice([-3, 0, 70000, -(2**63), 2**63 - 1]), r.randint(-2, 70000)) for _ in range(300)] + [(5, 5)] * 100
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(keys)], "a long, b long, i int")
    ordered = sorted(keys)
    for k in (0, 1, 57, 299, 333, 400):
        got = sorted((x.a, x.b) for x in df.where(resample.up_to(df, [F.col("a"), F.col("b")], k)).collect())
        assert got == [x for x in ordered if k and x <= ordered[k - 1]]


def test_checksums_of_pairs():
    r = random.Random(8)
    for _ in range(200):
        a, b = r.randbytes(r.randint(0, 20)), r.randbytes(r.randint(0, 300))
        got = resample.shifted(np.array([crc32(a)], dtype=np.uint32), np.array([len(b)])) ^ np.uint32(crc32(b))
        assert int(got[0]) == crc32(a + b)
