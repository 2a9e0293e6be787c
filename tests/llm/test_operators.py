import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import attention, bpe, components, decontam, html, langid, linededup, lm, quality, queries, simhash, syncmers, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, removed int, id int"
WORDS = "alpha beta gamma delta river stone cloud ember forest meadow signal harbor lantern copper violet thunder winter orchid".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ing", "ed"]) for _ in range(n))


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "src", len(t) if t is not None else None, 7, 8) for i, t in enumerate(texts)], DOCS)


EDGES = [None, "", "a", "\n\n \t", "x" * 20000, "same words here again", "same words here again", "12 34"]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (3, 1)] + [(i, i + 1) for i in range(20, 60)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 20 for i in range(20, 61)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()
    w = low.split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    base = [prose(120, i) for i in range(12)]
    texts = EDGES + base + [b.replace("river", "rivers", 1) for b in base] + [b + " end" for b in base] + base[:3]
    got = {r.doc_id: r for r in simhash.components(docs(spark, texts)).collect()}
    fps = [plain_simhash(t or "") for t in texts]
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == fps
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[max(find(i), find(j))] = min(find(i), find(j))
    assert [got[i].component_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    kept = simhash.keep_one(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})
    assert kept.columns == docs(spark, texts).columns


def test_anchors_cover_all_pairs():
    r = random.Random(5)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), r.randint(0, 2)):
            b ^= 1 << k
        index, anchor = simhash._anchors(np.array([a, b], dtype=np.uint64).view(np.int64))
        assert set(anchor[index == 0]) & set(anchor[index == 1])


def test_bpe_against_tokenizers(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    library = Tokenizer.from_file(path)
    texts = EDGES + [prose(80, 1), "It's 42!? <|endoftext|> É ΣΑΣ İ", "a\x1cb\x85c 's ''s", "thethethe" * 300]
    got = {r.doc_id: r for r in bpe.digests(bpe.round_trip(docs(spark, texts), path)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_decontamination(spark):
    item = "A farmer has 12 apples and gives 5 kg of pears to Anna before noon. Then Anna sells 12 apples at the old market near the river"
    other = item.replace("12", "40").replace("Anna", "Bruno").replace("5 kg", "9 kg")
    broken = item.replace("12", "40", 1).replace("Anna", "Bruno", 1)
    texts = [f"{prose(40, 1)}.\n{item}. {prose(30, 2)}", f"{prose(9, 3)}. {other}. {prose(50, 4)}", f"{prose(5, 5)}. {broken}. {prose(5, 6)}", prose(300, 7), *EDGES]
    benchmark = spark.createDataFrame([(1, item), (2, prose(5, 99)), (3, None), (None, "x")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.leaks(docs(spark, texts), benchmark).collect()}
    assert set(got) == {0, 1} and got[0].same_slots and not got[1].same_slots
    kept = decontam.clean(docs(spark, texts), benchmark)
    assert {r.doc_id for r in kept.collect()} == set(range(2, len(texts))) and kept.columns == docs(spark, texts).columns
    assert decontam.leaks(docs(spark, []), benchmark).count() == 0


def test_line_dedup_against_brute_force(spark):
    r = random.Random(2)
    lines = [prose(r.randint(6, 40), i) for i in range(40)]
    lines += [x[: len(x) // 2] + "#" + x[len(x) // 2 + 1 :] for x in lines[:20]] + lines[5:15] + ["short line"] * 4
    r.shuffle(lines)
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, len(lines), 3)] + EDGES
    places = [(d, n, x.strip(" ").lower()) for d, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if len(x.strip(" ")) >= 30]
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for _, _, x in places]
    root = list(range(len(places)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(places)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    want = {places[i][:2] for i in range(len(places)) if find(i) != i}
    assert {(x.doc_id, x.line_no) for x in linededup.removals(docs(spark, texts)).collect()} == want
    out = linededup.dedup_lines(docs(spark, texts))
    assert out.columns == docs(spark, texts).columns
    for x in out.collect():
        t = texts[x.doc_id]
        if t is None:
            assert x.text is None
        else:
            left = "\n".join(y for n, y in enumerate(t.split("\n")) if (x.doc_id, n) not in want)
            assert x.text == left and x.n_chars == len(left)


def test_exact_repeats_of_short_lines_go(spark, tmp_path):
    texts = ["of, edti oner.\nown", "Of, edti oner. \nx", "\n\nx", prose(12, 1) + "\n" + prose(12, 1)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: list(r.removed) for r in queries.op10_line_minhash(spark, str(tmp_path)).collect()}
    assert got == {0: [], 1: [0], 2: [2], 3: [1]}
    kept = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, texts), short=True).collect()}
    assert kept == {0: texts[0], 1: "x", 2: "\n", 3: prose(12, 1)}


def test_html(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>Menu</ul></nav><div class='ad'>Buy</div>"
        "<article><h1>Title &amp; more</h1><p>One  <b>bold</b>word.<br>Two<p>Three &lt;x&gt;</p><div class=comments><p>Nice!</div></article><footer>F</footer></body></html>"
    )
    plain = "<body><div>Site</div><div>Own text of page {0} is long enough to matter here</div><p>Second own line of {0}</p><div>Bottom</div></body>"
    rows = [(1, "http://a.x/p/1", page), (2, "http://b.x/p/1", plain.format("one")), (3, "https://b.x/p/2?q=1", plain.format("two")), (4, None, None), (5, "x", "")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[1] == "Title & more One boldword. Two Three <x>"
    assert got[4] == got[5] == ""
    assert "Own text of page one" in got[2] and "Second own line of two" in got[3]
    assert html.shared_lines(["a", "b", "c", "d"], ["x", "a", "c", "d", "b"]) == {0, 2, 3}
    assert len(html.shared_lines(["a", "b", "c", "b"], ["b", "a", "b", "c"])) == 2  # the first b meets the first b only


def test_html_articles_of_the_template(spark):
    """An article element that the neighbour has too is template beside an own one; an own article's shared lines stay."""
    page = "<body><article><h2>Read next</h2><p>Ten tips</p></article><article><h1>Page {0}</h1><p>A passage of both</p><p>Text {0}</p></article></body>"
    alone = "<body><article><p>Same in both</p></article><div>Only {0} here</div></body>"
    rows = [(i, f"http://a.x/p/{i}", page.format(i)) for i in (1, 2)] + [(i, f"http://b.x/p/{i}", alone.format(i)) for i in (3, 4)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {1: "Page 1 A passage of both Text 1", 2: "Page 2 A passage of both Text 2", 3: "Same in both", 4: "Same in both"}


def test_syncmers(spark):
    texts = [*EDGES, prose(200, 1), prose(200, 2)]
    rows = {r.doc_id: r for r in syncmers.edited_fingerprints(docs(spark, texts)).collect()}
    full = [t or "" for t in texts]
    for i, t in enumerate(full):
        n = len(t) // 2
        edited = t[: len(t) - n] + full[(i + 1) % len(full)][:n]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert rows[5].fingerprint == rows[6].fingerprint and rows[5].near_next == 1.0 and rows[0].near_next == 1.0
    assert 0.15 < rows[8].near_edited < 0.9 and rows[8].near_next < 0.1
    found = syncmers.anchors(docs(spark, texts[-2:] + ["zero " + texts[-2]]))
    m = {(r.left_id, r.right_id, r["shift"]): r.n for r in syncmers.matches(found, found).collect()}
    assert m[0, 2, 1] > 50


def labelled(spark, good, bad, label, n=160):
    rows = [(i, (good if i % 2 else bad)(i)) for i in range(n)]
    d = spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc_id long, text string")
    return d, spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], "doc_id long, quality int, toxic int").select("doc_id", F.col(label))


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, module, label):
    d, y = labelled(spark, lambda i: prose(40, i) + (" you idiot" if label == "toxic" else ""), lambda i: prose(40, i) if label == "toxic" else prose(40, i).upper(), label)
    got = module.classify(d, y).collect()
    assert len(got) == 162 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 160]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.9 * len(held)
    assert module.classify(d, y.where("doc_id < 0")).count() == 162


def test_language_id(spark):
    other = [" ".join(reversed(prose(60, i))) for i in range(30)]
    rows = [(i, prose(60, i), "aa") for i in range(30)] + [(100 + i, t, "bb") for i, t in enumerate(other)] + [(300, None, None), (301, "12 !", "aa"), (302, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    assert all(got[i].lang_pred == ("aa" if i < 100 else "bb") for i in got if i < 300)
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3
    (model,) = langid.fit(d)
    p = np.exp2(-model.cost.reshape(-1, 256).astype(float)).sum(axis=1)  # every language's row of every context it has seen
    assert np.allclose(p, 1, atol=1e-3)
    assert langid.identify(d.where("doc_id < 0")).count() == 0


def toy_model(texts, ids=60, passes=3):
    count = np.bincount(np.concatenate([*texts, [ids - 1] * len(texts)]), minlength=ids).astype(float)
    of = attention.layout(count, ids - 2, ids - 1)
    fit = attention.Fit(attention.untrained(of), of, 0.01)
    for _ in range(passes):
        fit.learn(texts)
    return attention.Model(of, fit.p)


def plain_log10(model, text):
    """The score of one text, place by place, as the module's docstring says it."""
    of, p = model.of, {k: v.astype(np.float64) for k, v in model.p.items()}
    inputs, targets = [of.begin, *text], [*text, of.end]
    total = 0.0
    for t in range(len(targets)):
        k = 0 if t < attention.WINDOW else -(-(t + 1 - attention.WINDOW) // attention.STRIDE)
        seen = inputs[k * attention.STRIDE : t + 1]
        x = np.array([p["embed"][of.to_output[i]] + p["place"][n] for n, i in enumerate(seen)])
        a = np.exp((x[-1] @ p["query"]) @ (x @ p["key"]).T)
        h = np.append(x[-1] + (a / a.sum()) @ (x @ p["value"]) @ p["mix"], 1.0)
        out = of.to_output[targets[t]]
        c = of.of_output[out]
        z, low = h @ p["top"], h @ p["low"][:, of.first[c] : of.first[c + 1]]
        total += z[c] - np.log(np.exp(z).sum()) + low[out - of.first[c]] - np.log(np.exp(low).sum()) + of.share[targets[t]]
    return total / np.log(10)


def test_attention_gradients_and_total(monkeypatch):
    monkeypatch.setattr(attention, "OUTPUTS", 40)
    monkeypatch.setattr(attention, "OWN_CLASS", 8)
    monkeypatch.setattr(attention, "CLASSES", 14)
    monkeypatch.setattr(attention, "BANDS", 3)
    random_ids = np.random.default_rng(0)
    texts = [random_ids.integers(0, 57, n) for n in (0, 3, 31, 32, 40, 100)]
    model = toy_model(texts)
    of = model.of
    assert np.allclose(model.log10_probabilities(texts), [plain_log10(model, t) for t in texts], rtol=1e-4)
    # All ids after one context have a total probability of 1: outputs by class and member, ids by their share.
    shares = np.bincount(of.to_output, weights=np.exp(of.share))
    assert np.allclose(shares, 1) and of.first[-1] == len(of.total) and (np.diff(of.first) > 0).all()
    inputs, targets, use = attention.windows(of, texts)
    assert use.sum() == sum(len(t) + 1 for t in texts)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, g = attention.gradients(p, of, inputs, targets, use)
    for name in p:
        q = {k: v.copy() for k, v in p.items()}
        q[name][1, 2] += 1e-5
        up = attention.gradients(q, of, inputs, targets, use)[0]
        q[name][1, 2] -= 2e-5
        assert np.isclose((up - attention.gradients(q, of, inputs, targets, use)[0]) / 2e-5, g[name][1, 2], rtol=1e-3, atol=1e-6), name


def test_attention_step_works_out_own_classes_only(monkeypatch):
    """The logits of a training step: all classes, and within classes no output beside those of a target's own class."""
    r = np.random.default_rng(5)
    ids = 3000
    texts = [np.minimum(r.zipf(1.2, n), ids - 3) for n in (5, 40, 300, 900)]
    count = np.bincount(np.concatenate([*texts, [ids - 1] * len(texts)]), minlength=ids).astype(float)
    of = attention.layout(count, ids - 2, ids - 1)
    inputs, targets, use = attention.windows(of, texts)
    clip, seen = np.clip, []
    monkeypatch.setattr(attention.np, "clip", lambda x, *a, **k: (seen.append(x.size), clip(x, *a, **k))[1])
    p = attention.untrained(of)
    loss, g = attention.gradients(p, of, inputs, targets, use)
    classes = of.of_output[targets[use]]
    inside = np.diff(of.first)[classes][classes >= attention.OWN_CLASS].sum()
    assert inside > 0 and sum(seen) == inputs.size * attention.WINDOW + len(classes) * attention.CLASSES + inside
    # Written over by other windows' gradient and again by these, the arrays are the same.
    first = {k: v.copy() for k, v in g.items()}
    for part in (slice(0, 2), slice(None)):
        attention.gradients(p, of, inputs[part], targets[part], use[part], g)
    assert loss > 0 and all(np.array_equal(first[k], g[k]) for k in g)


def test_attention_learns_more_than_counts():
    """Ids that follow from those before: the network finds what counts of single ids can't."""
    r = np.random.default_rng(3)
    texts = [np.concatenate([[a, a + 1, a + 2, a + 3] for a in r.integers(0, 12, 30) * 4]) for _ in range(60)]
    model = toy_model(texts[:50], passes=40)
    held = texts[50:]
    p = np.bincount(np.concatenate(texts[:50]), minlength=60) / sum(map(len, texts[:50]))
    alone = sum(np.log10(p[t]).sum() for t in held)
    assert model.log10_probabilities(held).sum() > 0.5 * alone


def test_lm_base(spark):
    texts = [*EDGES, *(prose(30, i) for i in range(20))]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in lm.score(d, queries.byte_vocabulary_path()).collect()}
    held = {r.doc_id for r in d.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2").collect()}
    words = [[w.lower() for w in (t or "").split()] + [""] for t in texts]
    from collections import Counter

    c = Counter(w for i, ws in enumerate(words) if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(words):
        r = got[i]
        assert r.held_out == (i in held) and r.train_tokens == n and r.n_tokens == len(ws) and r.n_known == sum(c[w] > 0 for w in ws)
        assert np.isclose(r.base_score, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0


def test_lm_counts_and_rounds_cover_all_documents(spark):
    source = open(queries.byte_vocabulary_path(), "rb").read()
    vocab = lm.vocabulary(source)
    ids = vocab.n_vocab + 2
    texts = [*EDGES, *(prose(60, i) for i in range(30))]
    assert [vocab.decode(lm.encode(vocab, t)) for t in texts] == [t or "" for t in texts]
    assert all(np.array_equal(lm.unpack(lm.pack(x)), x) for x in (np.array([], "<u4"), np.array([1, 65535], "<u4"), np.array([1, 65536], "<u4")))
    rows = docs(spark, texts).select(F.col("doc_id").alias("row"), "doc_id", F.lit(False).alias("held_out"), "text")
    coded = [lm.encode(vocab, lm.plain(t)).astype(np.int64) for t in texts]
    one, three = (lm.encoded(rows.repartition(n, "doc_id"), source).persist() for n in (1, 3))
    count = lm.id_counts(three, ids, ids - 1)
    assert np.array_equal(count, np.bincount(np.concatenate([*coded, [ids - 1] * len(coded)]), minlength=ids))
    of = attention.layout(count, ids - 2, ids - 1)
    start = attention.untrained(of)
    # One task and one round is a plain fit over all texts in the task's order; more tasks give the weighted mean of theirs.
    alone = attention.Fit(start, of, 0.01)
    alone.learn([lm.unpack(r.ids) for r in one.select("ids").collect()])
    assert alone.targets == sum(len(t) + 1 for t in coded)
    got = lm.follow(start, of, one, rounds=1, rate=0.01, draw=1)
    assert all(np.allclose(got[k], alone.p[k], atol=1e-5) for k in got)
    parts = []
    for part in range(3):
        own = [lm.unpack(r.ids) for r in three.where(F.spark_partition_id() == part).select("ids").collect()]
        if own:
            f = attention.Fit(start, of, 0.01, seed=part)
            f.learn(own)
            parts.append(f)
    got = lm.follow(start, of, three, rounds=1, rate=0.01, draw=1, least_steps=0)
    n = sum(f.targets for f in parts)
    assert n == alone.targets
    assert all(np.allclose(got[k], sum(f.p[k] * f.targets for f in parts) / n, atol=1e-5) for k in got)
    before = attention.Model(of, start).log10_probabilities(coded).sum()
    assert attention.Model(of, lm.follow(start, of, three, rounds=2, rate=0.01, draw=1)).log10_probabilities(coded).sum() > before
    one.unpersist()
    three.unpersist()


def test_lm_learns_from_every_window(spark, monkeypatch):
    """Each target of each training text is in one step of one round, as ``score`` runs them."""
    texts = [prose(n, i) for i, n in enumerate((1, 5, 40, 400, 1500) * 8)]
    d = spark.createDataFrame([(i, i, False, t) for i, t in enumerate(texts)], "row long, doc_id long, held_out boolean, text string")
    with open(queries.byte_vocabulary_path(), "rb") as f:
        source = f.read()
    vocab = lm.vocabulary(source)
    ids = vocab.n_vocab + 2
    coded = lm.encoded(d.repartition(3, "doc_id"), source).persist()
    of = attention.layout(lm.id_counts(coded, ids, ids - 1), ids - 2, ids - 1)
    summed, seen = lm._summed, []

    def watched(rows, key, *others):
        if key == "part":
            seen.extend(r.n for r in rows.where("slot = 0").select("n").collect())
        return summed(rows, key, *others)

    monkeypatch.setattr(lm, "_summed", watched)
    lm.follow(attention.untrained(of), of, coded)
    assert sum(seen) == sum(len(lm.encode(vocab, lm.plain(t))) + 1 for t in texts)
    coded.unpersist()


def test_top_words_are_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", 1000 // (i + 1) + 1) for i in range(500)], "word string, n long")
    got = {w for w in lm.top_words(counts, 50).column("word").to_pylist()}
    assert 10 < len(got) <= 50 and got == {f"w{i}" for i in range(len(got))}
    assert lm.top_words(counts.where("n < 0"), 50).num_rows == 0


def test_parameters_are_not_cut():
    assert attention.WINDOW - attention.STRIDE >= 8  # inputs before a later window's first target, its own besides
    assert attention.CLASSES >= 96 and attention.OWN_CLASS >= 64 and attention.OUTPUTS >= 4096
    assert (1 - 0.8**linededup.BAND) ** (linededup.SLOTS // linededup.BAND) < 0.006


def test_decontamination_edges(spark):
    benchmark = spark.createDataFrame([(1, "42"), (2, "Rome"), (3, "It has 12 legs"), (4, "")], "item_id long, text string")
    texts = ["we saw 42 of them in Rome", "42", "Look: it has 12 legs and it runs", "It has 13 legs", *EDGES]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs(spark, texts), benchmark).collect()}
    assert got == {(1, 1), (2, 3)}  # a number or name alone is an item only where nothing else is said
    assert decontam.leaks(docs(spark, texts), benchmark.where("item_id < 0")).count() == 0
    assert decontam.clean(docs(spark, texts), benchmark).count() == len(texts) - 2


def test_next_document_with_sparse_null_and_repeated_ids(spark):
    r = random.Random(9)
    rows = [(r.getrandbits(62) - (1 << 61), prose(30, i)) for i in range(60)] + [(None, prose(20, 70)), (None, None), (5, "a b"), (5, "a b"), (5, "c d")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = syncmers.with_next(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()
    assert len(got) == len(rows)
    ids = [x.doc_id for x in got]
    ordered = sorted(got, key=lambda x: (x.doc_id is not None, x.doc_id or 0))
    by_id = {}
    for x in ordered:
        by_id.setdefault(x.doc_id, set()).add(x.text)
    keys = list(by_id)
    for k, after in zip(keys, keys[1:] + keys[:1]):
        last = [x.next_text for x in got if x.doc_id == k]
        assert all(t in by_id[k] | by_id[after] for t in last) and sum(t in by_id[after] - by_id[k] or after == k for t in last) >= 1
    assert sorted(map(str, ids)) == sorted(str(i) for i, _ in rows)


def test_pages_do_not_depend_on_partitions(spark):
    """Old pages without article: the shared lines go, whatever the partitions, and every page loses its template."""
    def body(i, host):
        lines = [f"Welcome to {host}", "Latest news", *(f"Story {i} of {host} part {k} " + prose(6, 100 * i + k) for k in range(3)), f"All about {host}", "Write to us"]
        return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"

    rows = [(100 * h + i, f"http://h{h}.x/a/{i}", body(i, f"h{h}")) for h in range(3) for i in range(20)] + [(999, "http://h0.x/a/3", body(3, "h0"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "3", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(tuple(r) for r in html.extract(pages).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 61
    for page_id, _, text, n in found[0]:
        assert "Welcome" not in text and "Write to us" not in text and "Latest" not in text and text.count("Story") == 3 and n == len(text)


def test_shared_lines_against_brute_force():
    r = random.Random(1)

    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(200):
        a, b = (r.sample("abcdefghij", r.randint(0, 9)) for _ in range(2))
        assert len(html.shared_lines(a, b)) == lcs(a, b)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, module, label):
    d, y = labelled(spark, lambda i: prose(40, i) + " you idiot", lambda i: prose(40, i), label, 40)
    more = spark.createDataFrame([(None, "x", 1.0), (7, prose(30, 7), 1.0), (7, prose(30, 7), 1.0), (900, "long words here " * 20000, 1.0)], "doc_id int, text string, score double")
    both = d.select(F.col("doc_id").cast("int").alias("doc_id"), "text", F.lit(0.0).alias("score")).unionByName(more)
    got = module.classify(both, y).collect()
    assert len(got) == 46 and all(0 <= r.score <= 1 for r in got)
    assert module.classify(both.where("doc_id < -5"), y).count() == 0


def test_language_edges(spark):
    d = spark.createDataFrame([(i, prose(50, i), "aa") for i in range(40)] + [(90, "long text again " * 20000, "aa")], "doc_id long, text string, lang string")
    model = langid.fit(d)
    clash = d.withColumn("score", F.lit(7)).withColumn("lang_pred", F.lit("zz"))
    got = langid.predict(clash, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "bits_per_byte"] and {r.lang_pred for r in got.collect()} == {"aa"}
    foreign = spark.createDataFrame([(1, "\u0440\u0443\u0441\u0441\u043a\u0438\u0439 \u0442\u0435\u043a\u0441\u0442 " * 20)], "doc_id long, text string")
    assert langid.predict(foreign, model).first().bits_per_byte > 1


def plain_ppm(train, text):
    """Bits of text by escape method C with exclusion, context by context."""
    from collections import Counter, defaultdict

    seen = defaultdict(Counter)
    for t in train:
        b = b"   " + t.encode().lower()
        for i in range(3, len(b)):
            for k in range(4):
                seen[b[i - k : i]][b[i]] += 1

    def shares(context):
        if context not in seen:
            return shares(context[1:])
        c, below = seen[context], shares(context[1:]) if context else [1 / 256] * 256
        left = sum(below[x] for x in range(256) if x not in c)
        base = sum(c.values()) + (len(c) if left > 0 else 0)
        return [c[x] / base if x in c else len(c) / base * below[x] / left for x in range(256)]

    b = b"   " + text.encode().lower()
    return -sum(np.log2(shares(b[i - 3 : i])[b[i]]) for i in range(3, len(b)))


def test_language_codes_against_plain_ppm(spark):
    groups = {lang: [prose(12, 100 * k + i) for i in range(6)] for k, lang in enumerate(("aa", "bb"))}
    groups["bb"] = [" ".join(t.split()[::-1]).replace("e", "\u00e9") for t in groups["bb"]]
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in groups.items() for t in ts)]
    (model,) = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["", "a", prose(8, 999), "\u00e9t\u00e9 Alpha", "zzz \u4f60\u597d"]
    data = [t.encode() for t in texts]
    got = model.bits(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = [[plain_ppm(groups[lang], t) for lang in ("aa", "bb")] for t in texts]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_language_groups_and_limits(spark):
    other = [" ".join(w[::-1] for w in prose(60, i).split()) for i in range(40)]
    rows = [(i, prose(60, i), "aa") for i in range(40)] + [(100 + i, t, "bb") for i, t in enumerate(other)] + [(300 + i, t.upper().replace("E", "\u00df"), "cc") for i, t in enumerate(other)]
    rows += [(500, None, None), (501, "12", "aa"), (502, "word", None), (500, prose(9, 1), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, several = langid.fit(d), langid.fit(d, group=2)
    assert [m.langs for m in several] == [["aa", "bb"], ["cc"]] and len(one) == 1
    a, b = (sorted((str(r.doc_id), r.text or "", r.lang_pred, round(r.score, 6), round(r.bits_per_byte, 5)) for r in langid.predict(d, m).collect()) for m in (one, several))
    assert a == b and len(a) == len(rows)
    # A language all of whose texts are held back has no limit; the others keep theirs.
    back = next(i for i in range(1000, 2000) if d.sparkSession.range(i, i + 1).where("pmod(xxhash64(id, 7), 8) = 0").count())
    odd = d.unionByName(spark.createDataFrame([(back, "\u4f60\u597d " * 40, "zz")], d.schema))
    (model,) = langid.fit(odd)
    assert np.isinf(model.limit[model.langs.index("zz")]) and np.allclose(model.limit[:3], one[0].limit) and np.isfinite(model.limit[:3]).all()
    # One odd text among those held back doesn't move the limit far: noise stays over it.
    junk = [(2000 + i, "".join(chr(random.Random(i).randrange(33, 127)) for _ in range(400)), "aa") for i in range(60) if i % 30 == 0]
    (model,) = langid.fit(d.unionByName(spark.createDataFrame([(back, junk[0][1], "aa")], d.schema)))
    noise = spark.createDataFrame([(1, "".join(chr(random.Random(77).randrange(161, 1000)) for _ in range(300)))], "doc_id long, text string")
    assert langid.predict(noise, [model]).first().bits_per_byte > 1


def test_results_outlive_a_pipeline_run(spark, tmp_path):
    import corpus_pipeline

    d = docs(spark, [prose(40, i) for i in range(12)])
    bench = spark.createDataFrame([(1, prose(12, 3))], "item_id long, text string")
    found = decontam.leaks(d, bench)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() >= 0 and out.count() >= 0
    empty = tmp_path / "none"
    d.where("false").write.parquet(f"{empty}/documents.parquet")
    bench.write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_lm_words_alone_make_the_score(spark):
    a = "Alpha beta\n\n gamma  Delta"
    d = docs(spark, [a, "alpha beta gamma delta", *(prose(30, i) for i in range(20))])
    got = {r.doc_id: r for r in lm.score(d, queries.byte_vocabulary_path()).collect()}
    assert got[0].score == pytest.approx(got[1].score) and lm.plain(a) == "alpha beta gamma delta" and lm.plain(None) == ""


def test_pipeline(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_pipeline_contents(spark, tmp_path):
    """Each stage's decision on a small table: who goes, who stays, and that all columns pass."""
    import corpus_pipeline

    same = prose(120, 500)
    item = prose(40, 600)
    rows = [(i, prose(80, i), "en") for i in range(40)] + [(50, None, "en"), (51, "", "en"), (52, "12 34 !", "en"), (60, same, "en"), (61, same, "en"), (70, f"{prose(30, 71)}\n{item}\n{prose(30, 72)}", "en"), (80, "very long words " * 9000, "en")]
    d = spark.createDataFrame([(i, t, x, 1.5, "doc", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, score double, id string, n_chars int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, seen = d, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, left, str(tmp_path))
        assert i == 4 or out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in left.select("doc_id").collect()}
    everyone = {i for i, _, _ in rows}
    assert seen["language_id"] == everyone - {50, 51, 52}
    assert seen["line_dedup"] == seen["language_id"]
    lines = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/line_dedup").collect()}
    assert lines[60] == same and lines[61] == "" and lines[70].count("\n") == 2
    assert seen["simhash_dedup"] == seen["line_dedup"] and seen["decontaminate"] == seen["simhash_dedup"] - {70}
    assert seen["bpe"] == seen["decontaminate"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["bpe"])
