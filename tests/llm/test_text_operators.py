"""Brute-force checks and edge cases of the operators on single texts."""

import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import language, licenses, line_dedup, pii, quality, tokens
from sensorloom.llm.queries import tokenizer_path

LONG = "word " * 30_000
ROWS = [(1, "the cat is on the mat and it is not at home", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "der hund ist nicht in dem haus und die katze auch nicht", "de", "b"), (4, LONG, "en", "a"), (4, LONG, "en", "a"), (5, "12 34 %%", "de", "b")]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("score", "kept", "n_words", "_text", "found", "n"):  # clashing names
        extra = extra.withColumn(name, F.lit("x"))
    return extra


def sf(spark, name="documents"):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


def test_language_accuracy_on_held_out(spark):
    found = language.identify(sf(spark)).join(sf(spark).select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.98
    assert found.score.between(0, 1).all()
    assert all(language.is_held_out(i) for i in found.doc_id)


def test_language_probabilities_sum_to_one():
    m = language.fit_ppm({"x": [b"abracadabra" * 30], "y": [b"hello world " * 30]}, min_context=2)
    a = m.size
    p = np.exp2(-m.bits.reshape(-1, a, 2)[:, 1:-1, :].astype(float)).sum(axis=1)
    seen = a - 2
    rest = np.exp2(-m.bits.reshape(-1, a, 2)[:, -1, :].astype(float)) * (256 - seen)
    assert np.allclose(p + rest, 1, atol=1e-3)


def test_language_code_length_is_the_sum_of_its_bytes():
    m = language.fit_ppm({"x": [b"abracadabra" * 30], "y": [b"hello world " * 30]}, min_context=2)
    text = b"abra hello"
    line = [0, 0, 0, *m.symbol[np.frombuffer(text, np.uint8)].tolist()]
    a = m.size
    want = sum(m.bits[m.state[(line[i - 3] * a + line[i - 2]) * a + line[i - 1]] * a + line[i]].astype(float) for i in range(3, len(line)))
    got = m.lengths(np.frombuffer(b"zz" + text, np.uint8), np.array([0, 2, 2, 2 + len(text)]))
    assert np.allclose(got[2], want) and (got[1] == 0).all()


def test_language_edges(spark, docs):
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[5].lang_pred == "und" and got[2].score == 0
    assert got[None].held_out is False and got[1].lang_pred in ("en", "de")
    assert language.identify(docs.limit(0)).count() == 0


def brute_ppm(samples, min_context):
    """Bits of a text under each language by walking its context trees byte by byte."""
    seen = sorted({b for texts in samples.values() for t in texts for b in t})
    counts = {x: {} for x in samples}
    for x, texts in samples.items():
        for t in texts:
            line = [None, None, None, *t]
            for i in range(3, len(line)):
                for o in range(4):
                    own = counts[x].setdefault(tuple(line[i - o : i]), {})
                    own[line[i]] = own.get(line[i], 0) + 1
    kept = {()}
    for c in {c for x in counts for c in counts[x]}:
        if sum(sum(counts[x].get(c, {}).values()) for x in counts) >= min_context:
            kept.add(c)

    def own(x, context):
        while context not in kept or context not in counts[x]:
            context = context[1:]
        return context

    def below(x, context, s):
        """Probability of a byte unseen in a context, given the escape."""
        if not context:
            return 1 / max(1, 256 - len(counts[x][()]))
        up = own(x, context[1:])
        rest = {k: n for k, n in counts[x][up].items() if k not in counts[x][context]}
        whole = sum(rest.values()) + len(rest)
        if rest.get(s):
            return rest[s] / max(whole, 1)
        return below(x, up, s) * (len(rest) / max(whole, 1) if rest else 1)

    def bits(text):
        out = []
        for x in sorted(samples):
            line, total = [None, None, None, *text], 0.0
            for i in range(3, len(line)):
                s, c = line[i] if line[i] in seen else "other", own(x, tuple(line[i - 3 : i]))
                n = counts[x][c]
                whole = sum(n.values()) + len(n)
                p = n[s] / whole if s in n else below(x, c, s) * len(n) / whole
                total -= np.log2(max(p, 2.0**-40))
            out.append(total)
        return out

    return bits


def test_language_code_lengths_are_a_tree_walks():
    rng = random.Random(3)
    samples = {x: ["".join(rng.choice(words) + " " for _ in range(60)).encode() for _ in range(3)] for x, words in (("a", ["the", "then", "hat"]), ("b", ["der", "den", "hut", "tag"]), ("c", ["zz", "azb"]))}
    texts = [b"the hat", b"der tag und", b"", b"zzz then", "näher".encode(), b"azb azb"]
    off = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    for least in (2, 30):
        walk, m = brute_ppm(samples, least), language.fit_ppm(samples, min_context=least)
        assert np.allclose(m.lengths(data, off), [walk(t) for t in texts], rtol=1e-5, atol=1e-4)
    blocks = language.fit_blocks(samples, block_langs=2)
    each = [language.fit_ppm({x: samples[x] for x in part}).lengths(data, off) for part in (("a", "b"), ("c",))]
    assert blocks.langs == ["a", "b", "c"] and np.array_equal(blocks.lengths(data, off), np.concatenate(each, axis=1))


def test_tables_of_contexts_keep_within_their_bytes():
    rng = random.Random(4)
    samples = {x: [bytes(rng.choice(b"abcdefghij ") for _ in range(5000))] for x in "pqr"}
    small = language.fit_ppm(samples, most_bytes=20_000)
    assert small.bits.nbytes <= 20_000 < language.fit_ppm(samples).bits.nbytes
    assert language.fit_ppm(samples, most_bytes=1).bits.nbytes == 3 * 4 * small.size  # the root alone


def test_three_hundred_languages(spark):
    """Every text gets one of the languages learned, nearly always its own."""
    rng = random.Random(5)
    rows = []
    for k in range(300):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 7))) for _ in range(6)]
        rows += [(10 * k + i, " ".join(rng.choice(words) for _ in range(25)), f"l{k:03}") for i in range(8)]
    rows.append((9_999, "12 34", "l000"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").toPandas()
    words = found[found.doc_id != 9_999]
    assert (words.lang_pred != "und").all() and set(words.lang_pred) <= set(words.lang) and (found[found.doc_id == 9_999].lang_pred == "und").all()
    assert (words[words.held_out].lang_pred == words[words.held_out].lang).mean() > 0.95


def test_languages_without_short_texts(spark, monkeypatch):
    rows = [(i, "hello world " * 20, "en") for i in range(1, 6)] + [(i, "guten tag " * 900, "de") for i in range(6, 9)] + [(9, "guten tag " * 800, "de"), (10, "guten tag", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    m = language.learn(df, sample_bytes=2000)
    assert m.langs == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, m).collect()}
    assert got[10] == "de" and got[1] == "en"
    monkeypatch.setattr(language, "ONE_TEXT_BYTES", 5000)
    with pytest.raises(ValueError, match="de"):
        language.learn(df, sample_bytes=2000)
    with pytest.raises(language.NoLabelledText):
        language.learn(df.withColumn("lang", F.lit(None).cast("string")))


def brute_licence(text):
    words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})), words


def brute_templates(words, threshold=0.9):
    out = set()
    both = {(w,) for w in words} | set(zip(words, words[1:], strict=False))
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            own = {tuple(w.decode() for w in x) for x in licenses.tokens_of(t)}
            if len(own & both) < threshold * len(own) - 1e-9:
                continue
            n = len(licenses.words_of(t))
            width = next(b for b in licenses.BLOCK_WORDS if b >= 2 * n)
            for b in range(0, max(len(words), 1), width // 2):
                part = words[b : b + width]
                held = {(w,) for w in part} | set(zip(part, words[b + 1 : b + width + 1], strict=False))
                if len(own & held) >= threshold * len(own) - 1e-9:
                    out.add(label)
    return out


def test_licences_against_brute_force(spark):
    rows = [(i, t) for i, (t,) in enumerate(sf(spark).select("text").collect())]
    texts = [t for group in licenses.TEMPLATES.values() for t in group]
    rows += [(1000 + i, "lead " * i + t + " tail" * 40) for i, t in enumerate(texts)]
    rows += [(2000, "MIT License MIT license mit LICENSE"), (2001, "licensed under cc"), (2002, None), (2003, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r, (i, t) in zip(sorted(licenses.scan_licenses(df).collect(), key=lambda r: r["doc_id"]), rows, strict=True):
        n, k, first, last, base, words = brute_licence(t)
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (i, n, k, first, last, base)
        assert set(filter(None, r.labels.split(","))) == set(filter(None, base.split(","))) | brute_templates(words)
        assert 0 <= r.score <= 1


def test_licences_precision(spark):
    clean = ["4.0 cc: by then, he was licensed to drive under supervision", "the license was released under the bridge by mit", "general terms of the public work are licensed under a version of the year 3 gnu", "all rights of the public were reserved in part"]
    df = spark.createDataFrame(list(enumerate(clean)), "doc_id bigint, text string")
    assert all(r.labels == "" and r.score == 0 for r in licenses.scan_licenses(df).collect())
    held = {r.doc_id: r for r in licenses.scan_licenses(sf(spark)).collect()}
    texts = {r.doc_id: r.text or "" for r in sf(spark).collect()}
    for i, r in held.items():
        if not re.search("licen[cs]e|creative commons|rights reserved|CC BY", texts[i], re.I):
            assert r.labels == ""


def test_licences_edges(docs):
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(ROWS) and all(r.labels == "" for r in got)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows: dict = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n


def test_quality_against_brute_force(spark, docs):
    rows = [r[0] for r in sf(spark).select("text").collect()] + [r[1] for r in ROWS] + ["a b c d e a b c d e", "a b c d", "x\n\nx\n x\nx", "naïve — café\t#1"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    for r in quality.quality(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(rows[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert quality.quality(docs).count() == len(ROWS) and quality.quality(docs.limit(0)).count() == 0


def test_quality_is_one_narrow_projection(spark):
    plan = quality.quality(sf(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_line_dedup_removes_shifted_passage(spark, docs):
    passage = "\n".join(f"line {i} of a passage that is repeated in other texts" for i in range(40))
    rows = [(1, "own start\n" + passage), (2, "other\nlines\nin front\n" + passage + "\nand an end"), (3, "clean text\nof two lines")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[1].n_removed == 0
    assert got[2].n_removed == 40 and got[2].text.startswith("other\nlines")
    edge = line_dedup.dedup_lines(docs).collect()
    assert len(edge) == len(ROWS) and {r.doc_id: r.text for r in edge}[2] is None
    assert {r.doc_id: r.n_lines for r in edge}[3] == 1
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def brute_lines(rows, min_words=5):
    """Texts without the lines of pairs that stand at an earlier place, but for the lines of first places; and all pairs that repeat."""
    places, out = {}, {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        for k in range(len(lines) - 1):
            pair = "\n".join(lines[k : k + 2])
            if len(re.findall(r"[^ \t\n\x0b\f\r]+", pair)) >= min_words:
                places.setdefault(pair, []).append((i, k))
    repeated = {pair: at for pair, at in places.items() if len(at) > 1}
    first = {(i, k + x) for at in repeated.values() for i, k in at[:1] for x in (0, 1)}
    gone = {(i, k + x) for at in repeated.values() for i, k in at[1:] for x in (0, 1)} - first
    for i, t in rows:
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
    return out, repeated


def test_line_dedup_keeps_every_chunk_somewhere(spark):
    p, q, r = (f"the line called {x} of some words" for x in "pqr")
    rows = [(1, f"{p}\n{q}"), (2, f"{p}\n{q}\n{r}"), (3, f"{q}\n{r}"), (4, f"{p}\n{q}\n{r}")]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: f"{p}\n{q}", 2: f"{q}\n{r}", 3: "", 4: ""}
    rng = random.Random(9)
    lines = [f"one of the lines, number {i} of few" for i in range(12)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 7)))) for i in range(150)]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    want, repeated = brute_lines(rows)
    assert got == want and sum(got[i] != t for i, t in rows) > 50
    for pair, at in repeated.items():
        assert f"\n{pair}\n" in f"\n{got[at[0][0]]}\n"


def test_line_dedup_finds_short_passages_and_equal_lines(spark):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(rng.randrange(9, 30)))
    rows, inside = [], {}
    for n in range(2, 7):
        for _ in range(20):
            passage = [line() for _ in range(n)]
            for _ in range(2):
                inside[len(rows)] = passage
                rows.append((len(rows), "\n".join([*(line() for _ in range(rng.randrange(4))), *passage, *(line() for _ in range(rng.randrange(4)))])))
    for n in range(40):
        rows += [(len(rows) + i, "\n".join([f"line number {n} again and again"] * 60)) for i in range(2)]
    rows += [(len(rows), "x"), (len(rows) + 1, "\n\n\n"), (len(rows) + 2, "\n\n\n"), (len(rows) + 3, "a b c\nd e"), (len(rows) + 4, "a b c\nd e\nz")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert {i: r.text for i, r in got.items()} == brute_lines(rows)[0]
    for i, passage in inside.items():
        assert (passage[0] in got[i].text) == (i % 2 == 0)  # the second of two
    assert all(got[i].text == "" for i in range(201, 280, 2))


def test_line_dedup_shuffles_each_text_once(spark, monkeypatch):
    """Over all plans that it runs, one exchange carries texts or parts of them."""
    plans = []
    written = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: plans.append(df) or written(df, name))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = [(i, f"head {i} of it\nthe same line in all of them\nand one more of these lines\ntail {i}") for i in range(20)]
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
        explain = lambda df: spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        dealt = [c for df in [*plans, got] for c in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", explain(df))]
        assert len(dealt) >= 4 and sum(bool(re.search(r"\b(_text|_l|body)#", c)) for c in dealt) == 1
        assert sorted(r.n_removed for r in got.collect()) == [0] + [2] * 19
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_line_dedup_of_repeated_and_null_ids(spark):
    two = "a line of some words\nand one more line"
    rows = [(1, "own\n" + two), (1, "own\n" + two), (None, two), (None, two), (2, "front\n" + two + "\nend")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("at", F.lit("x")).withColumn("h", F.lit("x"))
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == sorted([(1, "own\n" + two, 0), (1, "own\n" + two, 0), (None, "", 2), (None, "", 2), (2, "front\nend", 2)], key=str)


def test_line_dedup_of_equal_texts_without_ids(spark, tmp_path):
    """Only one of equal texts without an id stays, from files and from memory."""
    two = "a passage of some words\nand one more such line"
    rows = [(None, two), (None, two), (None, two), (None, f"front\n{two}\nend"), (1, "own\ntext of it"), (None, None), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    df.write.parquet(str(tmp_path / "d"))
    for docs in (df, spark.read.parquet(str(tmp_path / "d"))):
        got = line_dedup.dedup_lines(docs).collect()
        texts = [r.text for r in got]
        assert len(got) == len(rows) and texts.count(None) == 2 and sum(two in t for t in texts if t is not None) == 1
        assert sum(r.n_removed for r in got) == 6 and "own\ntext of it" in texts


def test_pseudonyms(spark, docs):
    key = b"k"
    card, text = "4111 1111 1111 1111", "Card 4111 1111 1111 1111, mail a.b7@x.org, ip 10.0.0.255, on 2024-02-29 or 31/12/1999, call +1 (743) 555-3824, not 4111 1111 1111 1112"
    new, found = pii.pseudonymise_text(key, text)
    assert [f["kind"] for f in found[:6]] == ["card", "email", "ip", "date", "date", "phone"]
    swapped = re.search(r"Card ([\d ]+),", new)[1]
    assert swapped != card and len(swapped) == len(card) and pii.luhn_digit(swapped.replace(" ", "")[:-1]) == swapped[-1]
    assert re.search(r"on \d{4}-\d\d-\d\d or \d\d/\d\d/\d{4},", new) and new.endswith("4111 1111 1111 1112")
    assert pii.pseudonymise_text(key, "x 4111 1111 1111 1111")[0].endswith(swapped)  # linked
    assert pii.pseudonymise_text(b"other", text)[0] != new
    clean = "Nothing here: version 1.2.3, page 17, 3.14 and 12:30."
    assert pii.pseudonymise_text(key, clean) == (clean, [])
    got = pii.pseudonymise(docs, key)
    assert got.count() == len(ROWS) and {r.doc_id: r.text for r in got.collect()}[2] is None
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, b"")


def test_pseudonyms_of_values_beside_others():
    card, iban, key = "4111 1111 1111 1111", "BE68 5390 0754 7034", b"k"
    alone = {x: pii.pseudonymise_text(key, x)[0] for x in (card, card.replace(" ", ""), iban, "555 123 4567", "2024-02-29")}
    assert all(new != x for x, new in alone.items())
    for text, values in {
        f"{card} 12/25": [card],
        f"{card} 123": [card],
        f"{card.replace(' ', '')} 123": [card.replace(" ", "")],
        f"no 12 {card}": [card],
        f"555 123 4567 {card}": ["555 123 4567", card],
        "1234 2024-02-29 5678": ["2024-02-29"],
        f"{iban} AND": [iban],
        f"AB13 {iban} WITH THE": [iban],
        f"AB13 {card} x": [card],
    }.items():
        want = text
        for x in values:
            want = want.replace(x, alone[x])
        got, found = pii.pseudonymise_text(key, text)
        assert got == want and [text[f["first"] : f["last"]] for f in found] == values, text
    token = "9233A8EC" * 5
    new, found = pii.pseudonymise_text(key, f'TOKEN = "{token}"')
    assert re.fullmatch('TOKEN = "[0-9A-F]{40}"', new) and token not in new and found[0]["kind"] == "secret"
    assert pii.pseudonymise_text(key, "PassWord=Hunter2hunter")[1] == [{"kind": "secret", "first": 9, "last": 22}]


def test_long_secrets_leave_nothing_in_clear():
    rng, key = random.Random(3), b"k"
    for alphabet, form in (("0123456789abcdef", "token {}"), (string.ascii_letters + string.digits, "password={}")):
        for n in (127, 128, 129, 300, 5000):
            secret = "".join(rng.choice(alphabet) for _ in range(n))
            text = f"it says {form.format(secret)}, and more"
            new, found = pii.pseudonymise_text(key, text)
            assert len(new) == len(text) and len(found) == 1 and text[found[0]["first"] : found[0]["last"]] == secret
            held = new[found[0]["first"] : found[0]["last"]]
            assert set(held) <= set(alphabet) and not any(secret[i : i + 12] in held for i in range(0, n - 12, 12))
            assert pii.pseudonymise_text(key, f"a {form.format(secret)}")[0].endswith(held)
    # one to one where pieces are cut: texts that share all but one symbol stay different
    values = ["0" * 130 + f"{i:03d}" for i in range(500)] + [f"{i:03d}" + "0" * 130 for i in range(1, 500)]
    assert len({pii.permute_long(key, b"t", v, ("0123456789",)) for v in values}) == len(values)


def test_pseudonyms_of_an_empty_table(spark):
    got = pii.pseudonymise(spark.createDataFrame([], "doc_id bigint, text string, found string"), b"k")
    assert got.count() == 0 and got.columns == ["doc_id", "text", "n_found", "kinds", "found"]


def test_pseudonyms_follow_values_not_spellings():
    swap = lambda text: pii.pseudonymise_text(b"k", text)[0]
    y, m, d = swap("1999-12-31").split("-")
    assert swap("31/12/1999") == f"{d}/{m}/{y}" and swap("12/31/1999") == f"{m}/{d}/{y}" and swap("31.12.1999") == f"{d}.{m}.{y}"
    digits = lambda t: re.sub(r"\D", "", t)
    assert digits(swap("+17435553824")) == digits(swap("+1 743-555-3824")) == digits(swap("+1 (743) 555-3824"))
    assert swap("John@x.org").lower() == swap("john@x.org") and swap("John@x.org")[0].isupper()
    for clean in ("population 123 456 789 people", "ids 2020 1234 5678", "md5 9e107d9d372bb6826bd81d3542a419d6 ok", "order 7536784127813050", "build 000.123.456"):
        assert swap(clean) == clean
    for held in ("tel: 030 1234 5678", "key=9e107d9d372bb6826bd81d3542a419d6", "call 555-123-4567"):
        assert swap(held) != held


def test_pseudonyms_of_a_whole_table(spark):
    from sensorloom.llm.queries import op8_pii_pseudonyms

    plain = re.compile(r"[\w.+-]+@[\w.-]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<=oken = \")[0-9a-f]{40}|(?<!\d)4\d{15}(?!\d)|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])")
    before = {r.doc_id: r.text for r in sf(spark).select("doc_id", "text").collect()}
    after = {r.doc_id: r for r in op8_pii_pseudonyms(spark, "/root/testdata/sf0.001").collect()}
    assert before.keys() == after.keys()
    new: dict = {}
    for i, text in before.items():
        spans = [m.span() for m in plain.finditer(text or "")]
        spans = [(a, b) for a, b in spans if not re.fullmatch(r"4\d{15}", text[a:b]) or pii.luhn_digit(text[a : b - 1]) == text[b - 1]]
        if not re.search(r"\d", text or ""):
            assert after[i].text == text and after[i].n_found == 0
        for a, b in spans:
            if len(after[i].text) == len(text):
                assert after[i].text[a:b] != text[a:b] and new.setdefault(text[a:b], after[i].text[a:b]) == after[i].text[a:b]
            assert text[a:b] not in after[i].text or "." in text[a:b]
    assert len(set(new.values())) == len(new) >= 10


def test_permutations_are_one_to_one():
    for n in (10, 97, 366):
        assert sorted(pii.permute_below(b"k", b"t", i, n) for i in range(n)) == list(range(n))
    assert len({pii.permute_symbols(b"k", b"t", f"{i:03d}", ("0123456789",)) for i in range(1000)}) == 1000
    cards = {pii._card(b"k", f"400000000000{i:03d}" + pii.luhn_digit(f"400000000000{i:03d}")) for i in range(500)}
    assert len(cards) == 500
    days = {pii._date(b"k", f"2024-01-{d:02d}") for d in range(1, 32)}
    assert len(days) == 31


def test_tokens_of_other_rules(tmp_path):
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        stated = json.load(f)
    stated["normalizer"] = None  # keeps case
    (tmp_path / "other.json").write_text(json.dumps(stated), encoding="utf-8")
    texts = ["Don't STOP", "a  b", "", "Éa 12"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for path in (tokenizer_path(), f"{tmp_path}/other.json"):
        e = tokens.Encoder(path, 2)
        ids, counts = e(data, off)
        assert e.by_units == (path == tokenizer_path())
        assert np.split(ids, np.cumsum(counts)[:-1])[3].tolist() == [*e.tokenizer.encode(texts[3], add_special_tokens=False).ids, 2]
        assert ids.tolist() == [t for x in texts for t in [*e.tokenizer.encode(x, add_special_tokens=False).ids, 2]]


def test_tokens_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    odd = ["Don't STOP", "<|endoftext|> x", "a<b É× ÷ß ÀÉ", "İstanbul ẞ H̱x", "\x1cabc\x85def g", "naïve—dash…", "12345 6a7", "é É", "$$$###", " lead", "a\x00b", "é x"]
    rows = [(i, x) for i, (x,) in enumerate(sf(spark).select("text").collect())] + [(1000 + i, x) for i, x in enumerate(odd)] + [(5000, None), (5001, "")]
    folder = f"file://{tmp_path}/out"
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(tokens.tokenize(df, tokenizer_path(), folder=folder, file_bytes=20_000).collect(), key=lambda r: r.doc_id)
    start = 0
    dictionary = tokens._dictionary_of(spark, folder)
    for (i, x), r in zip(rows, got, strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(x)
        start += len(ids)
    assert len({r.file for r in got}) > 3
    r = got[-3]
    assert tokens.open_tokens(f"{folder}/{r.file}", dictionary).document(r.place)[1].tolist() == [*t.encode(odd[-1], add_special_tokens=False).ids, 2]
    with pytest.raises(ValueError):
        tokens.open_tokens(f"{folder}/{r.file}", b"other")
    assert tokens.tokenize(docs, tokenizer_path()).count() == len(ROWS)
    assert tokens.tokenize(docs.limit(0), tokenizer_path()).count() == 0
