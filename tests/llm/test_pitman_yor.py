"""The language model against brute force: its counts, its seatings' conditionals, and its scores from the seatings that it wrote."""

import math
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import pitman_yor as py

LONG = "alpha beta gamma " * 20_000
ROWS = [(i, t) for i, t in enumerate(["the cat is on the mat", "The Cat is on the sofa", None, "", "  \t\n ", "the the the", "a b c d e f g", LONG, "the cat is on the mat"] * 6)]
ROWS += [(None, "the dog is on the mat"), (-5, "the dog ate"), (3, "the cat"), (3, "the cat"), (2**62, "zebra xylophone")]


def brute_tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) + ["</s>"]


def brute_base(rows):
    learned = [brute_tokens(t) for i, t in rows if not py.is_held_out(i)]
    c = Counter(w for line in learned for w in line)
    n, v = sum(c.values()), len(c)
    return c, learned, [(i, py.is_held_out(i), len(x := brute_tokens(t)), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for i, t in rows]


def seatings(c):
    """Every way of seating c customers one after the other: sizes of tables."""
    arrangements = [(1,)] if c else []
    for _ in range(c - 1):
        arrangements = [a[:k] + (a[k] + 1,) + a[k + 1 :] for a in arrangements for k in range(len(a))] + [(*a, 1) for a in arrangements]
    return arrangements


def weight(sizes, discount):
    return math.prod(math.prod(j - discount for j in range(1, n)) for n in sizes)


@pytest.mark.parametrize("discount", [0.1, 0.5, 0.9])
def test_stirling_numbers_are_sums_over_seatings(discount):
    tables = py.log_stirling(discount, 7)
    for c in range(1, 8):
        by = Counter()
        for sizes in seatings(c):
            by[len(sizes)] += weight(sizes, discount)
        assert np.allclose(np.exp(tables[c]), [by[t] for t in range(1, c + 1)])


@pytest.mark.parametrize("discount", [0.2, 0.5, 0.8])
def test_saddle_point_is_near_the_table(discount):
    exact, missed = py.log_stirling(discount, 3000)[3000], py.saddle_error(discount, 1024)
    t = np.array([1.0, 2.0, 5.0, 20.0, 100.0, 400.0])
    at = lambda t: py.log_stirling_far(np.full(len(t), 3000.0), t, discount) + missed[np.minimum(t, len(missed) - 1).astype(int)]
    # what a draw depends on: ratios of neighbours
    assert np.abs((at(t + 1) - at(t)) - (exact[t.astype(int)] - exact[t.astype(int) - 1])).max() < 0.02


def test_gibbs_sweeps_reach_the_restaurants_posterior():
    """Two dishes in one restaurant: the share of each pair of table numbers over many sweeps is that of all seatings."""
    c, p, discount, strength, runs = [4, 3], [0.2, 0.05], 0.6, 0.7, 40_000
    want = Counter()
    for a, b in product(seatings(c[0]), seatings(c[1])):
        t = len(a) + len(b)
        want[len(a), len(b)] += weight(a, discount) * weight(b, discount) * p[0] ** len(a) * p[1] ** len(b) * math.prod(strength + discount * j for j in range(t))
    rng, t = np.random.default_rng(3), [np.ones(runs, int), np.ones(runs, int)]
    for _ in range(12):
        for k in (0, 1):
            t[k] = py.sample_tables(rng, np.full(runs, c[k]), discount, strength, t[1 - k].astype(float), np.full(runs, p[k]))
    got, total = Counter(zip(*(x.tolist() for x in t), strict=True)), sum(want.values())
    for key, w in want.items():
        assert abs(got[key] / runs - w / total) < 0.012, key


def test_draws_for_many_customers_agree_with_the_table(monkeypatch):
    rng, n, most = np.random.default_rng(5), 20_000, py.TABLE_MOST
    for c, others, p in ((300, 10.0, 0.3), (1000, 500.0, 0.01), (600, 3.0, 1e-5)):
        monkeypatch.setattr(py, "TABLE_MOST", most)
        a = py.sample_tables(rng, np.full(n, c), 0.6, 1.0, np.full(n, others), np.full(n, p))
        monkeypatch.setattr(py, "TABLE_MOST", 256)
        b = py.sample_tables(rng, np.full(n, c), 0.6, 1.0, np.full(n, others), np.full(n, p))
        assert abs(a.mean() - b.mean()) < 0.02 * a.mean() + 0.02 and abs(a.std() - b.std()) < 0.05 * a.std() + 0.05


def test_packed_numbers():
    for x in ([], [0], [255, 0, 3], [256], [2**40, 1], [2**63]):
        assert py.unpack(py.pack(np.array(x, np.uint64)), np.uint64).tolist() == x


def test_pairs_beyond_32_bits_are_told_apart():
    rng = np.random.default_rng(1)
    u, w = rng.integers(1, 5, 200), rng.integers(1, 5, 200)
    small, large = py.distinct_pairs(u, w), py.distinct_pairs(u + 2**40, w)
    assert (small[0] + 2**40 == large[0]).all() and (small[1] == large[1]).all() and (small[2] == large[2]).all()


def run(spark, monkeypatch, rows, **how):
    """Scores, and the tables written on the way."""
    kept, original = {}, py.written
    monkeypatch.setattr(py, "written", lambda df, name: kept.setdefault(name, []).append(original(df, name)) or kept[name][-1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for name in ("part", "chunk", "score", "held_out", "u"):  # clashing names
        docs = docs.withColumn(name, F.lit("x"))
    got = py.score_texts(docs, **how).collect()
    return got, {k: [[r.asDict() for r in df.collect()] for df in v] for k, v in kept.items()}


@pytest.mark.parametrize("size", [1, 1 << 23])
def test_scores_follow_from_the_seatings(spark, monkeypatch, size):
    samples = 2
    got, kept = run(spark, monkeypatch, ROWS, samples=samples, burn_in=1, chunk_bytes=size)
    counts, learned, base = brute_base(ROWS)
    key = lambda r: tuple(str(x) for x in r[:5])
    assert sorted(map(key, base)) == sorted(map(key, got))
    assert np.allclose(sorted(r[5] for r in base), sorted(r.base_score for r in got))

    pairs = Counter((a, b) for line in learned for a, b in zip(["<s>", *line], line, strict=False))
    many = {k: n for k, n in pairs.items() if n > 1}
    states = [[(py.unpack(r["c"]), py.unpack(r["t"]), py.unpack(r["u"]), py.unpack(r["w"])) for r in s if r["asker"] < 0] for s in kept["state"]]
    for state in states:
        assert sorted(np.concatenate([x[0] for x in state]).tolist()) == sorted(many.values())
        assert all(((1 <= t) & (t <= c)).all() for c, t, *_ in state)
    # numbers of words, from the words' counts at their places
    parts = len({r["part"] for r in kept["words"][0]})
    by_number, all_parts = {}, py.power_of_two(0)
    for r in kept["words"][0]:
        if r["chunk"] < 0:
            for place, n in enumerate(py.unpack(r["ids"])):
                by_number[place * all_parts + r["part"] + 1] = int(n)
    assert parts <= all_parts and sum(by_number.values()) == sum(counts.values()) + len(learned)

    # the parent's customers are the tables of all contexts of the sweep before, and a context's tables those of its words
    before = [np.concatenate([x[1] for x in s]) for s in states]
    assert (before[0] == 1).all() and len(before) == len(kept["root"]) == samples + 1
    c = np.concatenate([x[0] for x in states[0]])
    for sweep, root in enumerate(kept["root"]):
        own = [r for r in root if r["asker"] < 0]
        assert sum(py.unpack(r["customers"]).sum() for r in own) == sum(pairs.values()) - (c - before[sweep]).sum()
        assert sum(py.unpack(r["tables"]).sum() for r in own) == sum(pairs.values()) - (c - before[sweep]).sum() + counts["</s>"]
        for r in own:
            customers, tables = py.unpack(r["customers"]), py.unpack(r["root_tables"])
            assert ((tables <= customers) & ((tables > 0) == (customers > 0))).all()

    # the scores, by brute force
    once, twice = sum(n == 1 for n in pairs.values()), sum(n == 2 for n in pairs.values())
    d, v = py.discount_of(once, twice), len(counts)
    t_mean = {}
    for r in (r for r in kept["state"][-1] if r["asker"] < 0):
        for u, w, t in zip(py.unpack(r["u"]), py.unpack(r["w"]), py.unpack(r["total"]) + py.unpack(r["t"]), strict=True):
            t_mean[int(u), int(w)] = t / samples
    roots = []
    for root in kept["root"][-samples:]:
        own, word = [r for r in root if r["asker"] < 0], {}
        for r in own:
            for place, x in enumerate(zip(*(py.unpack(r[k]) for k in ("tables", "customers", "root_tables")), strict=True)):
                word[place * all_parts + r["part"] + 1] = tuple(map(int, x))
        roots.append((word, sum(x[1] for x in word.values()), sum(x[2] for x in word.values())))
    number = numbers_of(by_number, all_parts, counts)

    def p(u, w):
        un, wn = number.get(u), number.get(w)
        c_uw, c_u = pairs.get((u, w), 0), {"<s>": len(learned)}.get(u, counts.get(u, 0))
        mean = 0.0
        for word, customers, tables in roots:
            base = (py.STRENGTH + d * tables) / (v + 1)
            t_u, (_, m, t0) = word[un][0] if un else 0, word[wn] if wn else (0, 0, 0)
            mean += (py.STRENGTH + d * t_u) * (m - d * t0 + base) / (py.STRENGTH + customers) / samples
        t = t_mean[un, wn] if c_uw > 1 else c_uw
        return (c_uw - d * t + mean) / (py.STRENGTH + c_u)

    line = lambda t: zip(["<s>", *brute_tokens(t)], brute_tokens(t), strict=False)
    want = {(i, t): sum(math.log10(p(a, b)) for a, b in line(t)) for i, t in ROWS if t != LONG}
    mine = sorted((str(r.doc_id), round(r.score, 6)) for r in got if r.n_tokens < 1000)
    assert mine == sorted((str(i), round(want[i, t], 6)) for i, t in ROWS if t != LONG)
    for u in ("<s>", b"the", b"cat", b"never"):
        assert abs(sum(p(u, w) for w in [*counts, b"unseen"]) - 1) < 1e-9
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def numbers_of(by_number, parts, counts):
    """Number of each word, from its hash: places in a part go by falling count, then hash; the start's is the first of the last part."""
    import pyarrow as pa

    words = [w for w in counts if w != "</s>"]
    hashes = dict(zip(words, py.word_hashes(pa.array([w.decode() for w in words]))[0].tolist(), strict=True)) | {"</s>": int(py.END), "<s>": int(py.BEGIN)}
    shift = 64 - (parts.bit_length() - 1)
    out = {}
    for part in range(parts):
        own = sorted((w for w in hashes if hashes[w] >> shift == part), key=lambda w: (w != "<s>", -counts.get(w, 0), hashes[w]))
        out |= {w: k * parts + part + 1 for k, w in enumerate(own)}
    assert all(by_number[n] == counts.get(w, by_number[n]) for w, n in out.items())
    return out


def test_edges(spark, monkeypatch):
    assert run(spark, monkeypatch, [])[0] == []
    held = next(i for i in range(100) if py.is_held_out(i))
    alone = run(spark, monkeypatch, [(held, "nothing learned"), (held, None)])[0]
    assert sorted(tuple(r)[1:] for r in alone) == [(True, 1, 0, 0, 0.0, 0.0), (True, 3, 0, 0, 0.0, 0.0)]
    empty = run(spark, monkeypatch, [(None, None)])[0]
    assert [tuple(r)[:5] for r in empty] == [(None, False, 1, 1, 1)] and empty[0].score <= 0
    low, high = run(spark, monkeypatch, [(-(2**63), "a"), (2**63 - 1, "a")])[0]
    assert {low.doc_id, high.doc_id} == {-(2**63), 2**63 - 1}


def test_given_documents_are_scored_better_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = py.score_texts(docs).toPandas()
    assert len(got) == docs.count() and (got.score < 0).all()
    assert got[got.held_out].score.sum() > got[got.held_out].base_score.sum()
