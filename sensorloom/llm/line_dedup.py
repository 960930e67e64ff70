"""Repeated multi-line chunks, by content-defined boundaries.

A text's lines are hashed, and a rolling hash over ``WINDOW`` line hashes is taken at every
line. A chunk goes on as long as its rolling hashes repeat somewhere in the corpus, and a
boundary is where one does not. So boundaries depend on two lines only, whatever stands in front, and every
run of two lines or more that stands elsewhere too is a chunk or part of one, however short it is.
(Boundaries at rolling hashes with certain low bits, as for files, would leave most
passages of two to four lines whole inside longer chunks that differ; see the README.)

All of it is DataFrame expressions. The hashes are SHA-256 of lines and of two lines' hashes: windows are equal where
these are, so places and hashes are shuffled to compare them and no text is. A small table of what repeats
is written first, so that Spark can split a very common window's places over tasks where they meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

WINDOW = 2


def _rolling(hashes: Column, words: Column, min_words: int) -> Column:
    """Hash of each line and the next; null where the two have not ``min_words`` words."""
    enough = lambda i: F.get(words, i) + F.get(words, i + 1) >= min_words
    pair = lambda i: F.when(enough(i), F.unhex(F.sha2(F.concat(F.get(hashes, i), F.get(hashes, i + 1)), 256)))
    return F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), pair))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _text`` after the hashes of both, which name a row in joins; rows without an id are told apart by where they stand."""
    none, key = F.col(id_col).isNull(), F.xxhash64(F.col(text_col))
    if not docs.where(none).isEmpty():
        docs, at = numbered(docs.select(id_col, text_col))
        key = F.when(none, F.xxhash64(F.col(text_col), at)).otherwise(key)
    return docs.select(F.xxhash64(F.col(id_col)).alias("_idh"), key.alias("_key"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 5) -> DataFrame:
    """``id_col, text, n_lines, n_removed, changed`` of each row: the text without lines of chunks that stand at an earlier place (smaller id, then line).

    Two lines in a row repeat where the same two, of ``min_words`` words or more together, stand in a row at an
    earlier place; both go, but for lines that the first place of another repeated two holds, even if its other line
    repeats from somewhere else. So every chunk that goes still stands whole at its first place.

    Narrow rows of places and hashes are shuffled to find what repeats and where it stands first; then each text is
    shuffled once, to its row's places.

    Defined cases: a null text stays null and has no lines; an empty text is one empty line and
    stays. A text of repeated chunks only becomes empty. Rows that repeat an id and
    a text are one document, whose own first chunks stay in each of them; rows with a null id are documents of their
    own, also with equal texts, and come after all others, so their chunks are the repeats. Other columns are not read.
    """
    row = ["_idh", "_key"]
    src = _rows(docs, id_col, text_col)
    lines = src.select(*row, "_id", F.split("_text", "\n").alias("_l"))  # a null text has no line
    hashed = lines.select(*row, "_id", F.transform("_l", lambda x: F.sha2(x, 256)).alias("_h"), F.transform("_l", lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("_w"))
    places = hashed.select(*row, "_id", F.posexplode(_rolling(F.col("_h"), F.col("_w"), min_words)).alias("at", "h")).where("h is not null")
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_key", "at")
    first = written(places.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first"), "line-chunks")
    own = place.eqNullSafe(F.col("first"))
    marks = [F.collect_set(F.when(~own, F.col("at"))).alias("_again"), F.collect_set(F.when(own, F.col("at"))).alias("_first")]
    marked = places.join(first, "h").groupBy(*row).agg(*marks)

    d = src.join(marked, row, "left").select("_id", "_text", "_again", "_first", F.split("_text", "\n").alias("_l"))
    both = lambda c: F.array_union(c, F.transform(c, lambda i: i + 1))
    d = d.withColumn("_gone", F.coalesce(F.array_except(both("_again"), both("_first")), F.array().cast("array<int>")))
    n = F.greatest(F.coalesce(F.size("_l"), F.lit(0)), F.lit(0))
    changed = F.size("_gone") > 0
    stay = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("_gone"))
    text = F.when(changed, F.array_join(F.transform(stay, lambda i: F.get("_l", i)), "\n")).otherwise(F.col("_text"))
    return d.select(F.col("_id").alias(id_col), text.alias("text"), n.cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"), changed.alias("changed"))


def oracle_sql(min_words: int = 5) -> str:
    """The same as DuckDB SQL over ``documents`` with unique ids."""
    return rf"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null),
p as (select doc_id, i, x || chr(10) || lead(x) over (partition by doc_id order by i) as body from l),
m as (select doc_id, i, row_number() over (partition by body order by doc_id, i) as k, count(*) over (partition by body) as c from p
      where body is not null and len(regexp_extract_all(body, '[^ \t\n\x0B\f\r]+')) >= {min_words}),
f as (select doc_id, i from m where k = 1 and c > 1 union select doc_id, i + 1 from m where k = 1 and c > 1),
g as ((select doc_id, i from m where k > 1 union select doc_id, i + 1 from m where k > 1) except select doc_id, i from f),
k as (select l.*, g.i is not null as gone from l left join g on l.doc_id = g.doc_id and l.i = g.i)
select d.doc_id, case when d.text is null then null else coalesce(string_agg(k.x, chr(10) order by k.i) filter (where not k.gone), '') end as text,
       count(k.i)::bigint as n_lines, (count(k.i) filter (where k.gone))::bigint as n_removed, coalesce(bool_or(k.gone), false) as changed
from documents d left join k on d.doc_id = k.doc_id group by d.doc_id, d.text
"""
