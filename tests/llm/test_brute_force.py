"""The text operators against plain versions on small or generated inputs."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plantlens.llm import common, decontamination, graph, language, near_dedup, packing, pii, quality, token_counts, toxicity, urls
from plantlens.llm.queries import vocabulary_path


# 1 PII
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        odd = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
        if 13 <= len(digits) <= 19 and odd % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aZ0159.@+-_ ()%é\n4", max_size=60))
def test_pii_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_spans_of_real_values():
    text = "é a.b+c@x-y.example.com, 10.0.0.255 300.1.1.1, 4111 1111 1111 1111 +1 (988) 555-2485."
    assert pii.base_spans(text) == plain_spans(text) and len(pii.base_spans(text)) == 4


def test_pii_long_runs_are_quick():
    for c in "a1@+.-":
        pii.base_spans(c * 200_000)


def planted_mentions(n=300):
    """Documents by kind (id modulo 5): 0, 1 a clear mention, often repeated, and an unclear one of the same entity; 2 to 4 none unclear."""
    rng = random.Random(1)
    filler = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "order", "then", "we", "go", "with", "lamp", "tree"]) for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    rows = []
    for i in range(n):
        p, m = digits(10), digits(4)
        phone, mail = f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}", f"u{m}@host{m}.example.com"
        rows.append((i, [
            f"{filler(20)} call {phone} now {filler(60)} {rng.choice(['', phone])} {filler(30)} again {p[:3]}-{p[3:6]}-{p[6:]} end",
            f"{filler(10)} mail {mail} {filler(50)} {rng.choice(['', mail])} {filler(30)} u{m}@host{m} is mine",
            f"{filler(30)} order {digits(16)} and {digits(11)} {filler(9)}",
            f"{filler(9)} server 10.{rng.randrange(256)}.3.{rng.randrange(256)} {filler(9)} mail u{m}@host.example.com {filler(3)}",
            f"{filler(9)} number {p} {filler(40)} number {p}",
        ][i % 5]))
    return rows


def test_field_labels_unclear_mentions(spark):
    got = pii.report(spark.createDataFrame(planted_mentions(), "doc_id long, text string")).collect()
    added = Counter((r["doc_id"] % 5, r["n_added"]) for r in got)
    assert added[0, 1] >= 0.9 * 60 and added[1, 1] >= 0.9 * 60
    assert added[2, 0] == added[3, 0] == added[4, 0] == 60
    assert all(r["spans"].count("phone:") == r["n_phone"] + 1 for r in got if r["doc_id"] % 5 == 0 and r["n_added"])


def test_skip_edges_carry_the_label(spark):
    rows = planted_mentions()
    read = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", pii.candidates_of(F.col("text"))).select("doc_id", "h.*")
    field = pii.fit(read)
    assert field.skip[4, 4] > 2 and field.skip[1, 1] > 2
    for r in read.where("doc_id % 5 < 2").collect():
        free = [i for i, n in enumerate(r["nodes"]) if not n["label"]]
        alone = field.posterior(r["nodes"], [])[0]
        assert all(alone[i][[1, 4][r["doc_id"] % 5 == 0]] < pii.SURE for i in free)


def test_messages_equal_enumeration():
    rng = np.random.default_rng(4)
    for links, loose in ([(0, 1, 0), (1, 2, 1), (1, 3, 1)], 1e-3), ([(0, 1, 0), (1, 2, 0), (2, 3, 0)], 1e-3), ([(0, 1, 0), (1, 2, 0), (0, 2, 1), (2, 3, 0)], 0.1):
        field = pii.Field(rng.normal(0, 0.7, (pii.LABELS, pii.FEATURES)), rng.normal(0, 1, pii.LABELS))
        nodes = [{"label": k, "features": rng.integers(0, pii.PREVIOUS, 6).tolist()} for k in (0, 0, 0, 2)]
        want = np.zeros((4, pii.LABELS))
        for y in np.ndindex(*[pii.LABELS] * 3):
            y = (*y, 2)
            score = sum(field.unary(n["features"])[k] for n, k in zip(nodes[:3], y, strict=False)) + sum((field.skip if kind else field.chain)[y[a], y[b]] for a, b, kind in links)
            for i, k in enumerate(y):
                want[i, k] += np.exp(score)
        want /= want.sum(axis=1, keepdims=True)
        assert np.abs(field.posterior(nodes, links)[0] - want).max() < loose


def test_numbers_side_by_side_are_runs_of_their_own():
    text = "7536784127813050 4845168114407329 and 555 123-4567 or ab12345678 9b0b3c6a43eb78aa99 4111.1111.1111.1111"
    assert [text[a:b] for a, b in pii.runs(text)] == ["7536784127813050", "4845168114407329", "555 123-4567", "4111.1111.1111.1111"]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to a@b.cd or 10.0.0.1!"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in pii.redacted(df).orderBy("doc_id").collect()] == ["to <EMAIL> or <IP>!", None]


# 2 near-dedup
@pytest.mark.parametrize(("size", "threshold", "rows"), [(3, 85, 5), (5, 80, 4)])
def test_near_dedup_equals_all_pairs(spark, size, threshold, rows):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 300))]
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randrange(0, max(1, len(t) // 30))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    texts += ["a b", "A  b", "a", "", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.classes(df, threshold=threshold, shingle=size, rows=rows).collect()}
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_blocks_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for page in range(3):  # the third page's copies drift, so that many aren't linked with their hub
        base = [f"w{page}_{rng.randrange(500)}" for _ in range(120)]
        for _ in range(40):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(120)] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(t)))
            if page == 2:
                base[rng.randrange(120)] = f"y{rng.randrange(500)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(near_dedup.classes(df).select("doc_id", "component_id").collect())
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 900)
    assert sorted(near_dedup.classes(df).select("doc_id", "component_id").collect()) == one


def test_near_copies_of_a_page_take_linear_work(spark, monkeypatch):
    """Copies that link with their hub stay in one block each; only the hub goes to all of them."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 10)
    seen = []
    real = near_dedup.forest
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 32, near_dedup.HASHES, dtype=np.uint64).astype(np.uint32)
    monkeypatch.setattr(near_dedup, "forest", lambda reps, *a: seen.append(len(reps)) or real(reps, *a))
    frame = __import__("pandas").DataFrame({"key": 1, "block": np.repeat(np.arange(20), 10), "blocks": 20, "rep": np.where(np.arange(200) % 10 == 0, 0, np.arange(200)), "hub": 0, "signature": [sig.tobytes()] * 200})
    out = list(near_dedup.inside(iter([frame]), near_dedup.least_matches(0.85, 1e-6), 85, 3))
    assert sum(len(o) for o in out) == 180 and not any(o["small"].any() for o in out) and sum(seen) == 200


def test_an_id_with_two_texts_links_through_both(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "other words here now")]
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_miss_rate_equals_draws():
    rng = np.random.default_rng(2)
    least = near_dedup.least_matches(0.85, 1e-2)
    matches = rng.binomial(25, 0.85, (400_000, 5)).cumsum(axis=1)
    assert abs((matches < least).any(axis=1).mean() - near_dedup.miss_rate(0.85, 1e-2)) < 2e-3
    assert near_dedup.miss_rate(0.85, near_dedup.MISS) < 1e-5 and near_dedup.miss_rate(0.80, near_dedup.MISS) < 1e-5


def test_posterior_bound_is_the_beta_tail():
    rng = np.random.default_rng(1)
    for n, m in zip(range(25, 126, 25), near_dedup.least_matches(0.85, 1e-3), strict=True):
        tail = lambda k: (rng.beta(k + 1, n - k + 1, 400_000) >= 0.85).mean()  # noqa: B023, E731
        assert tail(m) >= 5e-4 and (m == 0 or tail(m - 1) <= 2e-3)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(70)] + [(3, 3), (None, 4)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}


# 3 decontamination
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("size", [1, 4, 5])
def test_decontamination_equals_a_loop(spark, size):
    rng = random.Random(2)
    vocab = ["a", "B", "é", "c1", "D"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "\n"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    items = [(i, text(rng.randrange(0, 12))) for i in range(9)]
    marked = decontamination.mark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=size)
    got = {r["doc_id"]: r for r in marked.select("doc_id", "text", "contamination.*").collect()}
    for i, t in docs:
        w = WORD.findall(lower(t))
        places = [m.span() for m in WORD.finditer(lower(t))]
        hit, found = set(), set()
        for k, item in items:
            v = WORD.findall(lower(item))
            for s in range(max(1, len(v) - size + 1)) if v else ():
                win = v[s : s + size]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(str(k))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(found))
        assert {k for h in got[i]["hits"] for k in range(h["start"], h["end"])} == hit
        assert all((h["from"], h["to"]) == (places[h["start"]][0], places[h["end"] - 1][1]) for h in got[i]["hits"])


def test_the_automaton_takes_about_a_node_a_word():
    rng = random.Random(6)
    items = [(str(i), " ".join(f"w{rng.randrange(3000)}" for _ in range(60))) for i in range(300)]
    windows = decontamination.Windows(items, 10)
    assert windows.machine.get_stats()["nodes_count"] <= 1.1 * 300 * 60
    assert windows.found([w.encode() for w in items[7][1].split()])[1] == {windows.ids.index("7")}


def test_a_benchmark_that_is_too_large_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_WORDS", 3)
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    with pytest.raises(ValueError):
        decontamination.benchmark_items(items, "item_id", "text")


# 4 toxicity
def test_nearest_equals_all_cosines():
    rng = random.Random(9)
    terms = {f"t{i}".encode(): 1.0 + rng.random() for i in range(40)}
    examples = [(i, i % 2, {w: rng.randrange(1, 4) for w in rng.sample(list(terms), rng.randrange(1, 9))}) for i in range(500)]
    index = toxicity.Index(terms, examples, {0: 1.0, 1: 1.0}, 0.5)
    for _ in range(60):
        words = [rng.choice(list(terms)) for _ in range(rng.randrange(1, 12))]
        asked = index.query(words)
        rows, cosines = index.nearest(*asked)
        weight = lambda c: {w: (1 + math.log(n)) * terms[w] for w, n in c.items()}
        q = weight(Counter(words))
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        all_ = sorted((-sum(q.get(w, 0) * x for w, x in weight(c).items()) / norm(q) / norm(weight(c)), i) for i, _, c in examples)
        want = [(i, -c) for c, i in all_[: toxicity.NEAREST] if c < 0]
        assert [round(c, 9) for c in cosines] == [round(c, 9) for _, c in want]


def test_far_blocks_are_skipped():
    """Postings of common terms are not opened for blocks whose bound can't reach the k-th best."""
    rng = random.Random(3)
    examples = [(i, i % 2, {b"common": 1, f"rare{i // 50}".encode(): 3, f"own{i}".encode(): 1}) for i in range(6400)]
    terms = {w: 1.0 for _, _, c in examples for w in c}
    index = toxicity.Index(terms, examples, {0: 1.0, 1: 1.0}, 0.5)
    every = sum(len(c) for _, _, c in examples)
    for _ in range(5):
        i = rng.randrange(6400)
        before = index.postings.opened + index.texts.opened
        rows, _ = index.nearest(*index.query([b"common", f"rare{i // 50}".encode()]))
        assert {r // 50 for r in rows.tolist()} == {i // 50}
        assert index.postings.opened + index.texts.opened - before < every / 50


def plain_scores(docs, labels):
    """Every score by plain loops over all examples, as the docstrings define it."""
    words = {i: Counter(WORD.findall(lower(t))) for i, t in docs.items() if t is not None}
    learn = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    share = sum(learn.values()) / len(learn)
    by_text = {}
    for i, y in sorted(learn.items()):
        if i in words:
            a, b = by_text.get(docs[i], (i, 0))
            by_text[docs[i]] = (a, max(b, y))
    ex = [(i, y, words[i]) for i, y in sorted(by_text.values())]
    n1, n0 = sum(y for _, y, _ in ex), sum(1 - y for _, y, _ in ex)
    df, d0, d1 = (Counter(w for c in cs for w in c) for cs in (words.values(), [c for _, y, c in ex if not y], [c for _, y, c in ex if y]))
    idf = {}
    for w in d0.keys() | d1.keys():
        ratio = abs(math.log((d1[w] + 0.5) / (n1 + 1)) - math.log((d0[w] + 0.5) / (n0 + 1)))
        sure = ratio >= 3 * math.sqrt(1 / (d1[w] + 0.5) + 1 / (d0[w] + 0.5)) and ratio >= math.log(4)
        idf[w] = math.log(1 + len(words) / df[w]) * (1 if sure else 0.2)

    def vector(c):
        v = {w: (1 + math.log(n)) * idf.get(w, 0.2 * math.log(1 + len(words))) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    ex = [(i, y, vector(c)) for i, y, c in ex if c]
    weight = {1: share / (n1 / (n1 + n0)), 0: (1 - share) / (n0 / (n1 + n0))}

    def vote(v, without=None):
        near = sorted((-sum(v.get(w, 0) * x for w, x in u.items()), i, y) for i, y, u in ex if i != without)[:15]
        near = [(-c, i, y) for c, i, y in near if -c >= 1e-12]
        return (2 * share + sum(c * weight[y] * y for c, _, y in near)) / (2 + sum(c * weight[y] for c, _, y in near))

    left_out = [vote(u, i) for i, _, u in ex]
    slope, shift = toxicity.fitted_curve(np.array(left_out), np.array([y for _, y, _ in ex], float), np.array([weight[y] for _, y, _ in ex]))
    return {i: toxicity.logistic(slope * toxicity.logit(vote(v)) + shift) if (v := vector(words.get(i, {}) if any(w in idf for w in words.get(i, {})) else {})) else share for i in docs}


def test_scores_equal_plain_loops(spark):
    rng = random.Random(12)
    docs = {i: " ".join([f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 15))] + ([f"bad{rng.randrange(4)}"] if i % 5 == 0 else [])) for i in range(240)}
    docs |= {500: None, 501: "", 502: "unheard", 503: docs[3], 504: docs[5], 505: docs[5] + " unheard of words, unheard again"}
    labels = {i: int(i % 5 == 0) for i in [*range(200), 503, 504]}
    got = toxicity.report(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()
    want = plain_scores(docs, labels)
    assert all(r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-6) for r in got) and len(got) == len(docs)


def test_the_curve_calibrates():
    rng = np.random.default_rng(5)
    votes = rng.random(20_000)
    y = (rng.random(20_000) < votes**2 / (votes**2 + (1 - votes) ** 2)).astype(float)
    slope, shift = toxicity.fitted_curve(votes, y, np.ones(20_000))
    assert abs(slope - 2) < 0.1 and abs(shift) < 0.1


def test_toxicity_held_out(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    labels = common.table(spark, d, "labels")
    x = toxicity.report(common.table(spark, d, "documents"), labels).join(labels, "doc_id").where("held_out and toxic is not null").select("toxic", "predicted", "score").collect()
    clean, toxic = [r for r in x if r["toxic"] == 0], [r for r in x if r["toxic"] == 1]
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    # Calibration: of the documents in a band of scores, about that share is toxic.
    assert np.mean([(r["score"] - r["toxic"]) ** 2 for r in x]) < 0.03
    assert abs(np.mean([r["score"] for r in x]) - len(toxic) / len(x)) < 0.03


# 5 urls
def test_pagerank_equals_power_iteration(spark):
    rng = random.Random(5)
    hosts = [f"h{i}" for i in range(15)]
    edges = sorted({(rng.choice(hosts), rng.choice(hosts)) for _ in range(40)})
    edges = [(a, b, rng.randrange(1, 4)) for a, b in edges if a != b]
    seeds = {"h0": 0.5, "h3": 0.5}
    ef = spark.createDataFrame([("allow", *e) for e in edges], "kind string, src string, dst string, n int")
    sf = spark.createDataFrame([("allow", h, w) for h, w in seeds.items()], "kind string, host string, weight double")
    got = {r["host"]: r["score"] for r in urls.propagated(ef, sf, rounds=60, settled=1e-9).collect()}
    out = Counter()
    for a, _, n in edges:
        out[a] += n
    score = dict(seeds)
    for _ in range(200):
        sent = Counter()
        for a, b, n in edges:
            sent[b] += 0.85 * score.get(a, 0.0) * n / out[a]
        rest = 1 - sum(sent.values())
        score = {h: sent[h] + rest * seeds.get(h, 0.0) for h in hosts}
    assert all(got.get(h, 0.0) == pytest.approx(v, abs=1e-4) for h, v in score.items())


# 7 packing
def plain_bfd(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((b for b in bins if b >= n), default=None)
        if fit is None:
            bins.append(capacity - n)
        else:
            bins[bins.index(fit)] -= n
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_packing_equals_piece_by_piece(lengths):
    runs = packing.best_fit_decreasing(Counter(lengths), 20)
    used = {}
    for n, first, end, bin_, at in runs:
        for k in range(end - first):
            used.setdefault(bin_ + k, []).append((at, n))
    for places in used.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
    assert sorted(20 - sum(n for _, n in p) for p in used.values()) == plain_bfd(lengths, 20)
    assert Counter(n for p in used.values() for _, n in p) == Counter(lengths)


def test_packed_documents_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = common.table(spark, sf_dir, "documents")
    got = packing.pack(docs, vocabulary_path()).collect()
    tokenizer = Tokenizer.from_file(vocabulary_path())
    want = {}
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[r["doc_id"], k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == len(plain_bfd([r["length"] for r in got], 4096))


def test_word_ids_equal_the_tokenizer_over_all_of_unicode():
    from tokenizers import Tokenizer

    vocabulary = Path(vocabulary_path()).read_text(encoding="utf-8")
    ids, tokenizer = packing.WordIds(vocabulary), Tokenizer.from_str(vocabulary)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    assert ids.of(["a\u0387b c \u0387 d\u00b7"])[0] == np.array(tokenizer.encode("a\u0387b c \u0387 d\u00b7", add_special_tokens=False).ids, "<u4").tobytes()
    texts = [" ".join(f"{c}x y{c} A{c}b {c} {c}{c}." for c in points[k : k + 50]) for k in range(0, 0x20000, 50)]
    rng = random.Random(2)
    marks = [c for c in points[:0x3100] if unicodedata.category(c)[0] in "MPSZ"] + list("aZé'<|> \n1")
    texts += ["".join(rng.choice(marks if rng.random() < 0.7 else points) for _ in range(rng.randrange(1, 40))) for _ in range(20_000)]
    want = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for text, got, w in zip(texts, ids.of(texts), want, strict=True):
        assert got == np.array(w.ids, "<u4").tobytes(), repr(text)


# 8 language
def test_language_held_out(spark, sf_dir):
    docs = common.table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    x = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert x.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_equals_plain_zstandard(spark, sf_dir):
    import zstandard as zstd

    docs = common.table(spark, sf_dir, "documents")
    bodies = language.fit_dictionaries(docs)
    got = {r["doc_id"]: r["language"] for r in language.predict(docs.select("doc_id", "text"), bodies).collect()}
    for r in docs.collect():
        t = r["text"]
        if not t or not any(c.isalpha() for c in t):
            assert (got[r["doc_id"]]["lang"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        sizes = {}
        for lang, body in bodies.items():
            how = zstd.ZstdCompressionParameters.from_level(language.LEVEL, dict_size=len(body), min_match=language.LEAST_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = len(zstd.ZstdCompressor(compression_params=how, dict_data=zstd.ZstdCompressionDict(body, dict_type=zstd.DICT_TYPE_RAWCONTENT)).compress(t.lower().encode() + language.PAD))
        first, second = sorted(sizes.values())[:2]
        assert got[r["doc_id"]]["lang"] == min(k for k, v in sizes.items() if v == first)
        assert got[r["doc_id"]]["narrow"] == (1 - first / second < language.MARGIN)
        assert got[r["doc_id"]]["sizes"] == list(sizes.values())


# 9 token counts
def plain_match(word, pieces):
    word, n, i = word + token_counts.END, 0, 0
    while i < len(word):
        k = next((k for k in range(len(word), i, -1) if word[i:k] in pieces), None)
        if k is None:
            return 0
        n, i = n + 1, k
    return n


@settings(max_examples=400, deadline=None)
@given(st.sets(st.text(alphabet="abc\n", min_size=1, max_size=4), max_size=12), st.lists(st.text(alphabet="abcd", min_size=1, max_size=12), max_size=6))
def test_longest_match_equals_greedy(pieces, words):
    pieces = {p.encode() for p in pieces}
    match = token_counts.LongestMatch(sorted(pieces))
    for w in words:
        assert match.count(w.encode()) == plain_match(w.encode(), pieces)


def test_token_counts_of_documents(spark, sf_dir):
    pieces = token_counts.read_pieces(vocabulary_path())
    held = set(pieces)
    docs = common.table(spark, sf_dir, "documents").limit(20)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.report(docs, pieces).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == sum(plain_match(w, held) or 1 for w in common.spaced_words(r["text"]))


# 10 quality
def test_quality_measures_equal_a_loop(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "a b c d e a b c d e"), (-2, "a a a a a a a"), (-3, "x\n\nx\n y\nx"), (-4, "a b c d"), (-5, "é|# \u00a0b\r\n\x0b")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    got = {r["doc_id"]: r for r in quality.report(docs).collect()}
    for r in docs.collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(windows)
        covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)


def log_odds(votes, share, rates):
    """Log odds of good to bad of a document with these votes."""
    by_vote = {-1: lambda b, g: math.log(g / b), 0: lambda b, g: 0.0, 1: lambda b, g: math.log((1 - g) / (1 - b))}
    return math.log((1 - share) / share) + sum(by_vote[v](*r) for v, r in zip(votes, rates, strict=True))


def test_unsettled_fits_are_reported(monkeypatch):
    patterns, _ = drawn(random.Random(3), 2000, 0.2, (0.7, 0.6, 0.5), (0.02, 0.05, 0.3))
    monkeypatch.setattr(quality, "ROUNDS", 2)
    assert not quality.estimated(list("abc"), patterns)[2]
    monkeypatch.undo()
    assert quality.estimated(list("abc"), patterns)[2]
    assert quality.estimated(list("abc"), {})[::2] == (quality.BELIEF_SHARE, True)
    votes = np.linspace(0.01, 0.99, 50)
    with pytest.raises(RuntimeError, match="not settled"):
        toxicity.fitted_curve(votes, (votes > 0.8).astype(float), np.ones(50), rounds=2)


def test_many_vote_patterns_are_fitted_quickly():
    import time
    from itertools import product

    patterns = {p: 1 + sum(v < 0 for v in p) for p in product((-1, 0, 1), repeat=9)}
    start = time.perf_counter()
    quality.estimated([str(k) for k in range(9)], patterns)
    assert time.perf_counter() - start < 60


def test_messages_that_have_not_settled_are_reported(monkeypatch):
    nodes, links = pii.read("call +49 30 1234567, or 0049 30 1234567 today, or 49301234567")
    nodes = [dict(zip(("label", "start", "end", "known", "features"), n, strict=True)) for n in nodes]
    field = pii.Field(np.random.default_rng(1).normal(size=(pii.LABELS, pii.FEATURES)))
    assert links and pii.spans_of(nodes, links, field)[2]
    monkeypatch.setattr(pii, "ROUNDS", 1)
    assert not pii.spans_of(nodes, links, field)[2]


@pytest.mark.parametrize("piece", ["1234567 ", "1 ", "12-", "1234567-", "+1 (2) ", "a@b ", "4111 1111 1111 1111 "])
def test_candidates_take_time_in_proportion(piece):
    import time

    def took(n):
        text = piece * (n // len(piece))
        start = time.perf_counter()
        pii.read(text)
        return time.perf_counter() - start

    took(20_000)
    assert took(800_000) < 24 * max(took(100_000), 0.02)


def test_the_benchmark_limit_counts_words(spark, monkeypatch):
    items = spark.createDataFrame([(1, "a-b c, D " * 10), (2, None), (None, "x y z " * 99)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "MOST_WORDS", 40)
    assert len(decontamination.benchmark_items(items, "item_id", "text")) == 2
    monkeypatch.setattr(decontamination, "MOST_WORDS", 39)
    with pytest.raises(ValueError, match="40 words"):
        decontamination.benchmark_items(items, "item_id", "text")


def test_unknown_words_count_in_the_norm():
    examples = [(k, int(k < 5), {b"bad": 1, f"x{k}".encode(): 1} if k < 5 else {b"fine": 1, f"x{k}".encode(): 1}) for k in range(10)]
    terms = {b"bad": 3.0, b"fine": 3.0} | {f"x{k}".encode(): 0.3 for k in range(10)}
    index = toxicity.Index(terms, examples, {0: 1.0, 1: 1.0}, 0.5, 0.5)
    alone, among = index.score("bad"), index.score("bad " + " ".join(f"u{k}" for k in range(20_000)))
    assert alone[2][0] > 0.9 and among[2][0] < 0.05 and abs(among[0] - 0.5) < abs(alone[0] - 0.5) / 4


def drawn(rng, n, share, bad, good, abstain=0.05):
    """Counts of vote patterns of n documents, and of the bad ones among them."""
    patterns, truth = Counter(), Counter()
    for _ in range(n):
        is_bad = rng.random() < share
        rates = bad if is_bad else good
        votes = tuple(0 if rng.random() < abstain else -1 if rng.random() < r else 1 for r in rates)
        patterns[votes] += 1
        truth[votes] += is_bad
    return patterns, truth


def test_expectation_maximisation_recovers_unequal_rules():
    bad, good = (0.7, 0.6, 0.5, 0.55, 0.8, 0.4), (0.02, 0.05, 0.3, 0.1, 0.01, 0.03)
    names = list("abcdef")
    patterns, truth = drawn(random.Random(3), 60_000, 0.2, bad, good)
    share, rates, _ = quality.estimated(names, patterns)
    assert abs(share - 0.2) < 0.02
    for name, b, g in zip(names, bad, good, strict=True):
        assert abs(rates[name][0] - b) < 0.02 and abs(rates[name][1] - g) < 0.02
    odds = {v: log_odds(v, share, [rates[k] for k in names]) for v in patterns}
    wrong = sum(truth[v] if odds[v] > 0 else n - truth[v] for v, n in patterns.items())
    best = sum(min(truth[v], n - truth[v]) for v, n in patterns.items())
    assert wrong <= best + 0.005 * 60_000


@pytest.mark.parametrize("rates", [(0.03, *[0.002] * 11), (0.1, *[0.002] * 11), (0.3, *[0.002] * 11), (0.02,) * 12])
def test_a_misfiring_rule_costs_a_clean_corpus_nothing(rates):
    names = [str(k) for k in range(12)]
    patterns, _ = drawn(random.Random(5), 20_000, 0.0, rates, rates)
    share, learned, _ = quality.estimated(names, patterns)
    lost = sum(n for v, n in patterns.items() if log_odds(v, share, [learned[k] for k in names]) < 0)
    assert lost <= 0.001 * 20_000


def test_word_measures_equal_a_loop(spark):
    texts = ["a# b|c | 12 -- é1", "THE!! to THEM! A É AB1 aB", "", None, "x" * 100_000, "#" * 50_000 + " a", "A" * 50_000, "Ünd ÀB CD\tE F1G\n\x0bH.I", "漢字 漢 ΑΒ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.measured(docs).select("text", "quality.*").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        assert r["n_distinct"] == len(set(w))
        assert r["n_marked_words"] == sum(any(c in "#*$%&|<>" for c in x) for x in w)
        assert r["n_letter_words"] == sum(any(map(str.isalpha, x)) for x in w)
        assert r["n_capital_words"] == sum(not re.search("[a-z]", x) and len(re.findall("[A-Z]", x)) >= 2 for x in w)


def test_quality_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = common.table(spark, sf, "labels").where("quality is not null").select("doc_id", "quality")
    rows = quality.report(common.table(spark, sf, "documents")).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((0, True), 0) <= 0.02 * n[0, False] and n.get((1, False), 0) <= 0.005 * n[1, True]
