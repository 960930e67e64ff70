"""Brute-force checks and edge cases of the operators across texts."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import archives, decontaminate, graph, mixing, near_dedup


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, threshold=80):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            p, q = sets[a][1], sets[b][1]
            if p and q and 100 * len(p & q) >= threshold * len(p | q):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    low: dict = {}
    for i, (key, _) in enumerate(sets):
        r = find(i)
        low[r] = key if low.get(r) is None else low[r] if key is None else min(low[r], key)
    return [(key, len(s), low[find(i)]) for i, (key, s) in enumerate(sets)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):  # chains: each text is some edits away from the one before
        text = [rng.choice(words) for _ in range(120)]
        for _ in range(14):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rng.choice([1, 2, 4, 7])):
                text[rng.randrange(len(text))] = rng.choice(words)
    base = [rng.choice(words) for _ in range(150)]
    for _ in range(150):  # a large group around one text
        text = list(base)
        for _ in range(rng.randrange(12)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["A b", "a B", "x", "", None, "  ", "x", " ".join(base), " ".join(base).upper()])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, shingle_words=k).collect())
    assert got == sorted(brute_components(rows, k))


def test_only_elements_that_can_make_a_pair_meet(spark):
    """Every row of a pair stays; rows whose class has no other side under their key, or no room for what the two need, go before anything is joined in pairs."""
    rng, rows = random.Random(3), []
    for c in range(60):
        for token in range(4):
            for low, high in ((0, 1), (1, 2), (2, 2)):
                for x in range(rng.randrange(6)):
                    kind = rng.choice([low, high])
                    need = {0: -rng.randrange(400), 1: 1 + rng.randrange(400), 2: 401 + rng.randrange(400)}[kind]
                    rows.append((x, c, rng.randrange(3), kind, need, 20, low, high, token, rng.randrange(1, 14)))
    columns = ["x", "c", "root", "class", "need", "nc", "low", "high", "token", "left"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in columns))
    kept = Counter(tuple(r) for r in near_dedup._with_partner(df, ["c", "token", "low", "high"], 80).collect())

    groups: dict = {}
    for r in rows:
        groups.setdefault((r[1], r[8], r[6], r[7]), []).append(r)
    wanted, one_sided = Counter(), 0
    for (_, _, low, high), g in groups.items():
        one_sided += len(g) if {r[3] for r in g} != {low, high} else 0
        wanted.update(a for a in g if any(a[2] != b[2] and a[3] + b[3] == low + high and min(a[9], b[9]) * 180 >= a[4] + b[4] + 20 * 20 for b in g))
    assert wanted and not wanted - kept and not kept - Counter(rows)
    assert one_sided > 100 and kept.total() < 1.5 * wanted.total() < len(rows) - one_sided
    for (_, _, low, high), g in groups.items():
        assert {r[3] for r in g} == {low, high} or not any(r in kept for r in g)


def test_near_duplicates_edges(spark):
    long = " ".join(str(i) for i in range(50_000))
    rows = [(5, "same text here now"), (5, "same text here now"), (None, "same text here now"), (None, "alone and without an id"), (3, None), (9, long), (8, long + " end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("x")).withColumn("n", F.lit(1))
    got = near_dedup.near_duplicates(df).collect()
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert len(got) == len(rows)
    assert by[9, 49_996].component_id == 8 and by[8, 49_997].kept and not by[9, 49_996].kept
    assert by[5, 1].kept and by[3, 0].component_id == 3
    alone = [r for r in got if r.doc_id is None]
    assert sorted(((r.component_id, r.kept) for r in alone), key=str) == [(5, False), (None, True)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.Generator(np.random.PCG64(1))
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    sig = near_dedup.superminhash(np.concatenate([a, b, a[:1]]), np.array([400, 400, 0, 1]), 256)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.1
    assert np.isinf(sig[2]).all()
    assert sorted(np.floor(sig[3]).astype(int)) == list(range(256))  # a single item fills every slot once


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100
    assert graph.components(edges.limit(0)).count() == 0


def test_period_keeps_every_source_within_a_block():
    for parts in ({"a": 1}, {"a": 500, "b": 300, "c": 199, "d": 1}, {f"s{i}": i + 1 for i in range(30)}):
        slots, q = mixing.period_slots(parts), sum(parts.values())
        assert sorted(s for own in slots.values() for s in own) == list(range(q))
        for name, own in slots.items():
            done = np.zeros(q + 1)
            done[np.array(own) + 1] = 1
            assert np.abs(np.cumsum(done) - np.arange(q + 1) * parts[name] / q).max() < 1


def test_mix_places_every_document(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(None, None), (7, "big")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string").withColumn("position", F.lit(1)).withColumn("other", F.lit("x"))
    got = sorted(mixing.mix(df, block_docs=4).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    counted = Counter(s for _, s in rows)
    weights = {s: n**0.5 for s, n in counted.items()}
    parts = mixing.whole_parts({str(s): w for s, w in weights.items()})
    shortest = min(-(-counted[s] // 4) / parts[str(s)] for s in counted)
    slots = int(shortest) * sum(parts.values())
    for s in counted:  # until the first source runs out, whole periods keep the weights
        mine = len({r.slot for r in got if r.source == s and r.slot < slots})
        assert abs(mine - slots * parts[str(s)] / sum(parts.values())) < 1
    assert mixing.mix(df.limit(0)).count() == 0


def test_phases_use_up_all_blocks():
    blocks, parts = {"a": 17, "b": 3, "c": 250}, {"a": 300, "b": 500, "c": 200}
    plan = mixing.phases(blocks, parts)
    used = Counter()
    for ph in plan:
        for s, a in ph.parts.items():
            assert ph.first[s] == used[s]
            used[s] += a * ph.periods
    assert used == Counter(blocks)


def off_target(blocks, weights, parts):
    """The most blocks that a source is away from its weight until the first one runs out, and the slots till then."""
    total, used, worst = sum(weights.values()), Counter(), 0
    for slots, (_, s, k) in enumerate(mixing.places(blocks, parts), 1):
        assert k == used[s]
        used[s] += 1
        worst = max(worst, max(abs(used[x] - slots * w / total) for x, w in weights.items()))
        if used[s] == blocks[s]:
            return worst, slots
    raise AssertionError("no source ran out")


def test_mix_keeps_weights_until_a_source_runs_out(spark):
    for n, weights in (({"a": 100, "b": 1000}, {"a": 0.5, "b": 0.5}), ({"hot": 5333} | {f"s{i}": 561 for i in range(19)}, None)):
        parts = mixing.whole_parts(weights or {s: x**0.5 for s, x in n.items()})
        worst, slots = off_target({s: -(-x // 16) for s, x in n.items()}, parts, parts)
        assert worst < 1 and slots > 10, (n, worst)
    rows = [(i, "a" if i < 100 else "b") for i in range(1100)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string"), {"a": 0.5, "b": 0.5}).collect()
    assert sorted(r.position for r in got) == list(range(1100))
    of = {r.slot: r.source for r in got}
    last = max(s for s, x in of.items() if x == "a")
    assert 12 <= last <= 13 and len(of) == 7 + 63
    assert all(abs(sum(of[i] == "a" for i in range(n + 1)) - (n + 1) / 2) < 1 for n in range(last + 1))


def test_mix_follows_given_weights_in_every_prefix(spark):
    for sizes, weights in (({"a": 64, "b": 64}, {"a": 0.9, "b": 0.1}), ({"a": 5000, "b": 1200, "c": 900, "d": 30}, {"a": 2.718281828, "b": 1.0, "c": 0.7, "d": 0.0007})):
        rows = [(len(s) + i, s) for s, n in sizes.items() for i in range(n)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string"), weights, block_docs=1).orderBy("slot").select("source").collect()
        used, total = Counter(), sum(weights.values())
        for n, (s,) in enumerate(got, 1):
            used[s] += 1
            assert all(abs(used[x] - n * w / total) < 1 for x, w in weights.items()), n
            if used[s] == sizes[s]:
                break
        assert Counter(r.source for r in got) == Counter(sizes)


def test_mix_of_many_sources_clashing_names_and_null_ids(spark):
    rows = [(i, f"s{i % 400}", "mine") for i in range(1200)] + [(None, "hot", "mine")] * 900
    df = spark.createDataFrame(rows, "doc_id bigint, source string, h string").withColumns({c: F.lit("mine") for c in ("s", "row", "doc", "_h", "bucket", "rank", "places")})
    for got in (mixing.mix(df.repartition(3)).toPandas(),):
        assert sorted(got.position) == list(range(len(rows)))
        assert (got[["h", "s", "row", "doc", "_h", "bucket", "rank", "places"]] == "mine").all().all()
        assert Counter(got.source) == Counter(s for _, s, _ in rows)


def test_mix_spreads_null_ids_over_buckets(spark, tmp_path):
    df = spark.range(30_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("hot").alias("source"))
    df.write.parquet(f"{tmp_path}/nulls")
    got = mixing.mix(spark.read.parquet(f"{tmp_path}/nulls"))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30_000 and got.select("position").distinct().count() == 30_000
    assert mixing.mix(got.select("doc_id", "source")).select("position").distinct().count() == 30_000


def test_mix_weights_are_not_rounded():
    n = {"hot": 1_000_000} | {f"s{i}": 105_263 for i in range(19)}
    for n, weights in ((n, {s: x**0.5 for s, x in n.items()}), ({"a": 160_000, "b": 1600}, {"a": 0.9999, "b": 0.0001})):
        worst, slots = off_target({s: -(-x // 16) for s, x in n.items()}, weights, mixing.whole_parts(weights))
        assert worst < 1 and slots > 10_000


def test_decontamination_finds_copies_and_paraphrases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = bench.orderBy("item_id").collect()
    rng = random.Random(3)
    clean = [r.text for r in docs.collect()]
    planted, changed = [], []
    for n, it in enumerate(items):
        words = it.text.split()
        host = clean[n % len(clean)].split()
        planted.append((10_000 + n, " ".join(host[:90] + words + host[90:]), it.item_id))
        body, answer = words[:-5], words[-5:]
        body = [w for w in body if rng.random() > 0.12]
        changed.append((20_000 + n, " ".join(host[:40] + body + answer + host[40:]), it.item_id))
    extra = spark.createDataFrame([(i, t) for i, t, _ in planted + changed] + [(1, None), (2, "")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs.unionByName(extra).withColumn("item_id", F.lit("x")), bench).collect()}
    assert {(i, b) for i, _, b in planted} <= got
    assert len({(i, b) for i, _, b in changed} & got) >= 0.9 * len(changed)
    flat = lambda t: " ".join(t.lower().split())
    for i, b in got:
        if i < 10_000:  # documents of the table: only those that hold the item
            assert flat(dict((x.item_id, x.text) for x in items)[b])[:40] in flat(dict(enumerate(clean)).get(i, "") if i < len(clean) else ""), (i, b)


def brute_contaminated(docs, items):
    """Documents and items by the checks alone: every passage of 128 words against every part."""
    words = lambda t: [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())]
    parts = []
    for item, t in items:
        w = words(t)
        size = -(-len(w) // max(1, -(-len(w) // 64)))
        parts += [(item, w[i : i + size], Counter(w[i : i + size])) for i in range(0, len(w), max(size, 1))]
    masks = []
    for _, w, _ in parts:
        m: dict = {}
        for i, t in enumerate(w):
            m[t] = m.get(t, 0) | 1 << i
        masks.append(m)
    out = set()
    for doc, t in docs:
        w = words(t)
        for lo in range(0, max(len(w) - 64, 1), 64):
            passage = w[lo : lo + 128]
            have = Counter(passage)
            for (item, p, count), m in zip(parts, masks, strict=True):
                if 2 * (have & count).total() < len(p):  # no longer subsequence than common words
                    continue
                share = decontaminate.lcs_length(m, len(p), passage) / len(p)
                answer = any(passage[i : i + len(p[-5:])] == p[-5:] for i in range(len(passage)))
                if share >= 0.8 or share >= 0.5 and answer:
                    out.add((doc, item))
    return out


def test_decontamination_query_against_brute_force(spark, tmp_path):
    from sensorloom.llm.queries import op7_decontaminate

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows, items = [tuple(r) for r in docs.collect()], [tuple(r) for r in bench.select("item_id", "text").collect()]
    rng = random.Random(11)
    vocabulary = sorted({w for _, t in rows for w in (t or "").split()})
    for n, (_, t) in enumerate(items):  # copies with replaced words, some with their answers
        w = (t or "").split()
        for share in (0.1, 0.3):
            changed = [rng.choice(vocabulary) if rng.random() < share and i < len(w) - 5 else x for i, x in enumerate(w)]
            host = (rows[n % 100][1] or "").split()
            rows.append((50_000 + len(rows), " ".join(host[:70] + changed + host[70:200])))
    rows.append((99_999, " ".join(["word"] * 30_000 + (items[0][1] or "").split())))
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in op7_decontaminate(spark, str(tmp_path)).collect()}
    want = brute_contaminated(rows, items)
    assert got <= want and len(got) >= 0.99 * len(want) and (99_999, items[0][0]) in got, (len(got), len(want), sorted(want - got)[:5])
    few = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench, block_parts=50, settings=decontaminate.Settings(rank=16))
    assert len({(r.doc_id, r.item_id) for r in few.collect()} & want) >= 0.9 * len(want)


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([(None, "a b c"), (1, None), (2, "")], "item_id bigint, text string")
    assert decontaminate.contaminated(docs, none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, one).collect()] == [(1, 1)]
    assert decontaminate.contaminated(docs.limit(0), one).count() == 0


def test_longest_common_subsequence():
    def slow(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        masks: dict = {}
        for i, t in enumerate(a):
            masks[t] = masks.get(t, 0) | 1 << i
        assert decontaminate.lcs_length(masks, len(a), b) == slow(a, b)


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    rows = [(1, "http://a b", "x"), (2, None, "y\r\n\r\nz"), (5, "u", "x"), (3, "ü", "x"), (None, "n", "y"), (7, "q", None), (8, "q", ""), (9, "r", "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("date", F.lit(1))
    got = {r.page_id: r for r in archives.convert_pages(pages, version=version, file_bytes=4000).collect()}
    first: dict = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        raw = (h or "").encode()
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *(("response", None) if first[h or ""] == i else ("revisit", first[h or ""])))
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    few = archives.convert_pages(pages, version=version, min_bytes=1000)
    assert {r.record_type for r in few.collect()} == {"response"}
    assert archives.convert_pages(pages.limit(0)).count() == 0


def test_legacy_archives_of_all_kinds(spark, tmp_path):
    import gzip

    http = b"HTTP/1.0 200 OK\r\nX-Page-Id: abc\r\n\r\nhello"
    v1 = [(b"http://a.org/x y", b"19961104142103", b"text/html; charset=utf-8", http), (b"dns:a.org", b"199611041421", b"text/dns", b"a.org. 1.2.3.4\n"), (b"http://b.org", b"19970101000000", b"text/html", http)]
    note = b"1 0 Crawler\nURL IP-address Archive-date Content-type Archive-length\n"
    records = [b"filedesc://x.arc 0.0.0.0 19961104142103 text/plain %d\n" % len(note) + note + b"\n"] + [b"%b 1.2.3.4 %b %b %d\n" % (u, d, c, len(x)) + x + b"\n" for u, d, c, x in v1]
    note2 = b"2 0 Crawler\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    two = b"filedesc://y.arc 0.0.0.0 19990101000000 text/plain 200 - - 0 y.arc %d\n" % len(note2) + note2 + b"\n" + b"http://c.org 1.2.3.4 19990101000000 text/html 200 abc - 99 y.arc %d\n" % len(http) + http + b"\n"
    for files in ({"x.arc": b"".join(records)}, {"x.arc.gz": gzip.compress(b"".join(records))}, {"x.arc.gz": b"".join(map(gzip.compress, records)), "y.arc": two}):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        for name, data in files.items():
            (folder / name).write_bytes(data)
        archives.convert(spark, f"file://{folder}", f"file://{folder}/out").collect()
        got = sorted(archives.read_warc(spark, f"file://{folder}/out").collect(), key=lambda r: r.date)
        assert [r.date for r in got][:3] == ["1996-11-04T14:21:00Z", "1996-11-04T14:21:03Z", "1997-01-01T00:00:00Z"]
        assert {(r.url, r.record_type) for r in got} == {("http://a.org/x y", "response"), ("dns:a.org", "resource"), ("http://b.org", "revisit")} | ({("http://c.org", "revisit")} if len(files) > 1 else set())
        assert len({r.record_id for r in got}) == len(got)


def test_archive_dates(spark):
    import datetime as dt

    pages = spark.createDataFrame([(1, "u", "x", dt.datetime(2001, 2, 3, 4, 5, 6)), (2, "u", "y", None)], "page_id bigint, url string, html string, seen timestamp")
    got = {r.page_id: r.date for r in archives.convert_pages(pages, date_col="seen").collect()}
    assert got == {1: "2001-02-03T04:05:06Z", 2: "2024-01-01T00:00:00Z"}


def test_archive_errors():
    good = b"http://x 0.0.0.0 20240101000000 text/html 3\nabc\n"
    import gzip

    assert next(archives.parse_arc(gzip.compress(good)))[1] == b"abc"
    with pytest.raises(ValueError):
        next(archives.parse_arc(gzip.compress(good.replace(b" 3\n", b" 9\n"))))
    with pytest.raises(ValueError):
        next(archives.parse_arc(gzip.compress(good.replace(b"text/html ", b""))))
    with pytest.raises(ValueError):
        list(archives.members(gzip.compress(good)[:-5]))


def test_pipeline_keeps_one_row_of_each_group(spark, tmp_path):
    import corpus_pipeline as P

    same, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59))
    rows = [(4, same), (4, same), (None, near), (None, same), (None, "quite other words stand here alone"), (None, "quite other words stand here alone"), (6, None), (7, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit("k")).withColumn("doc", F.lit("d"))
    df.repartition(3).write.parquet(f"{tmp_path}/rows")
    for docs in (df, spark.read.parquet(f"{tmp_path}/rows")):
        out = P.drop_near_duplicates(spark, docs, "")
        assert out.columns == df.columns
        assert sorted(((r.doc_id, r.text, r.key, r.doc) for r in out.collect()), key=str) == sorted([(4, same, "k", "d"), (None, rows[4][1], "k", "d"), (6, None, "k", "d"), (7, "", "k", "d"), (None, None, "k", "d")], key=str)
    assert P.identify_language(spark, df.withColumn("lang", F.lit(None).cast("string")), "").count() == 6


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    junk = spark.createDataFrame([(90_001, "123 456 %%", "en", "x", 10), (90_002, None, None, None, None)], docs.schema)
    docs = docs.unionByName(junk)
    kept = rows
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in docs.collect()}
        if name == "language":
            assert ids == {r.doc_id for r in before.collect()} - {90_001, 90_002}
        elif name == "near_duplicates":
            brute = brute_components([(r.doc_id, r.text) for r in before.collect()], 5)
            assert ids == {i for i, _, c in brute if i == c}
        elif name == "decontaminate":
            found = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert ids == {r.doc_id for r in before.collect()} - found and found
        else:
            assert ids == {r.doc_id for r in before.collect()}
    last = P.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == docs.count() <= kept
    order = [r.doc_id for r in docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert [r.doc_id for r in sorted(last, key=lambda r: r.start)] == order
    mixed = mixing.mix(spark.read.parquet(f"{tmp_path}/decontaminate")).orderBy("position").select("doc_id").collect()
    assert order == [r.doc_id for r in mixed]
