"""Quality rules: a threshold table compiled into one projection, without user functions.

Every measure is a count, every rule bounds ``100 * numerator`` by whole multiples
of the denominator, so the verdict needs no floating point. Words are
``[^\\x20\\x09-\\x0D]+``. All of it is a narrow projection: no shuffle, no Python.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it not of on or that the this to was with "
    "auf das dem den der des die ein eine im in ist mit nicht sich und von zu für "
    "au aux avec dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "al como con de del el en es las los no para por que se su un una y"
)


class Rule(NamedTuple):
    """Fails where ``100 * numerator`` is under ``low`` or over ``high`` times the denominator."""

    name: str
    numerator: str
    denominator: str
    low: int | None
    high: int | None


#: The two rules that alone make ``base_failed``.
BASE_RULES = (Rule("words", "n_words", "one", 1000, None), Rule("repeats", "n_repeat_words", "n_words", None, 20))
RULES = (
    Rule("word length", "word_chars", "n_words", 150, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 20),
    Rule("capitals", "n_capitals", "word_chars", None, 50),
    Rule("stop words", "n_stop_words", "n_words", 1, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 50),
)


def failed(rule: Rule) -> Column:
    value, base = 100 * F.col(rule.numerator), F.col(rule.denominator)
    tests = [t for t in (None if rule.low is None else value < rule.low * base, None if rule.high is None else value > rule.high * base) if t is not None]
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def any_failed(rules: tuple[Rule, ...]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | failed(rule)
    return out


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words() -> Column:
    """Words covered by 5-word windows that occur twice or more; the windows' hashes with their places, sorted, in ``_s``."""
    s = F.col("_s")
    again = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("last"))
    covered = F.aggregate(
        F.array_sort(F.transform(again, lambda x: x["i"])),
        start,
        lambda acc, p: F.struct((acc["n"] + p + F.lit(WINDOW - 1) - F.greatest(acc["last"], p - 1)).alias("n"), (p + F.lit(WINDOW - 1)).alias("last")),
        lambda acc: acc["n"],
    )
    return F.coalesce(covered, F.lit(0))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id_col``, the counts that the rules use, ``base_failed``, ``failed_rules`` (names) and ``kept``.

    Defined cases: a null text counts as one without words and fails, as does an
    empty one; a text of fewer than 5 words has no window and no repeats; rules over a
    denominator of 0 hold unless their numerator is above 0. Null and repeated ids
    come back as they are, row by row; other columns of ``docs`` are not read.
    Windows are compared by 64-bit hashes of their five words' hashes. The stop-word rule
    knows the languages of ``STOP_WORDS`` and fails running text of others: leave it out of ``rules`` there.
    """
    text = F.col("_t")
    d = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.select(
        id_col,
        "_t",
        F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("_l"),
    )
    w = F.col("_w")
    d = d.withColumn("_x", F.transform(w, lambda x: F.xxhash64(x)))  # each word is hashed once, a window combines five numbers
    at = lambda i, k: F.get("_x", i + k)
    hashes = F.transform(F.sequence(F.lit(0), F.size("_x") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    d = d.select(
        id_col,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        _count_of(text, CAPITALS).cast("long").alias("n_capitals"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(sorted(set(STOP_WORDS.split()))))).cast("long").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) > WINDOW, hashes).alias("_h"),
    )
    h = F.col("_h")
    repeated = F.size(F.array_distinct(h)) < F.size(h)
    d = d.withColumn("_s", F.when(repeated, F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    d = d.withColumn("n_repeat_words", _repeat_words().cast("long")).withColumn("one", F.lit(1))
    d = d.withColumn("base_failed", any_failed(BASE_RULES))
    names = F.filter(F.array(*[F.when(failed(r), F.lit(r.name)) for r in (*BASE_RULES, *rules)]), lambda x: x.isNotNull())
    d = d.withColumn("failed_rules", F.array_join(names, ",")).withColumn("kept", ~(F.col("base_failed") | any_failed(rules)))
    return d.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_capitals", "n_stop_words", "n_lines", "failed_rules")


def _sql_failed(rule: Rule) -> str:
    tests = [f"100 * {rule.numerator} < {rule.low} * {rule.denominator}"] if rule.low is not None else []
    tests += [f"100 * {rule.numerator} > {rule.high} * {rule.denominator}"] if rule.high is not None else []
    return "(" + " or ".join(tests) + ")"


def _sql_any(rules: tuple[Rule, ...]) -> str:
    return "(" + " or ".join(map(_sql_failed, rules)) + ")"


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rules as DuckDB SQL over ``documents``; rows are told apart by id."""
    stop = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS.split())))
    names = ", ".join(f"case when {_sql_failed(r)} then '{r.name}' end" for r in (*BASE_RULES, *rules))
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
win as (select doc_id, i, w[i:i+4] as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, count(distinct i + k) as n from rep, (select unnest(range(0, 5)) as k) group by doc_id),
m as (select w.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
             (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint as n_capitals,
             len(list_filter(w, lambda x: lower(x) in ({stop})))::bigint as n_stop_words, len(l)::bigint as n_lines, 1 as one
      from w left join cov on w.doc_id = cov.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_sql_any(BASE_RULES)} as base_failed,
       not ({_sql_any(BASE_RULES)} or {_sql_any(rules)}) as kept, n_capitals, n_stop_words, n_lines, concat_ws(',', {names}) as failed_rules
from m
"""
