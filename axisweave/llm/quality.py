"""Quality rules: counts of each text, and line frequency across the documents of a host.

Lines are normalised (ASCII lower case, white space to one space, trimmed) and hashed; for every host (``source``) the documents that hold a line
are counted: rows, each once however often the line is in it, copies and equal rows too. Lines in more than ``LINE_DOCS`` of them are
removed, however large the host is, and a document that is left with too little is rejected.

Only DataFrame functions run here, and no text is moved: the frequent lines of a host go to its documents while they are few by a check of their size (``LIST``,
``LIST_BYTES``); beyond that the keys of lines are joined with the frequent ones and each document gets its own.

Edge cases. A null text has no words, no lines, and fails the base rule; a null source is one host. Equal rows give equal results, one a row. A null doc_id is
kept, and doc_id may be of any type. Empty input gives no rows; other columns of the input, whatever their names, are ignored by ``judge`` and kept by ``keep``. Lines without a
word stay. Long texts are judged whole, as one row. Line keys are 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisweave.llm.common import WORD, WS, written

MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
#: A line is frequent in more than this many documents of a host.
LINE_DOCS = 50
#: Words and share of words that must be left.
LEFT_WORDS, LEFT_SHARE = 20, 0.2
#: Most frequent lines of a host, and bytes of all of them, that go to the documents as one list a host.
LIST, LIST_BYTES = 5_000, 16 << 20
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(line, UPPER, LOWERED), WS, " ")))


def _lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _keys(docs: DataFrame) -> DataFrame:
    """(row, host, line): the distinct line keys of every document; row is a hash of what is read of it."""
    texts = docs.select(_row(), F.col("source").alias("host"), _lines(_text()).alias("lines"))
    return texts.select("row", "host", F.explode(F.array_distinct(F.transform("lines", _line_key))).alias("line"))


def _row() -> Column:
    return F.xxhash64("doc_id", "source", "text").alias("row")


def frequent_lines(docs: DataFrame) -> DataFrame:
    """(host, line): the keys of each host's frequent lines."""
    return _keys(docs).groupBy("host", "line").count().filter(F.col("count") > LINE_DOCS).select("host", "line")


def _lists(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Lists of frequent lines (frequent), by host or, where they are long, by row, and the names of the key there and in the documents."""
    lines = written(frequent_lines(docs), "frequent")
    hosts = lines.groupBy("host").agg(F.count("*").alias("n"))
    longest, size = hosts.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum(8 * F.col("n") + F.coalesce(F.octet_length(F.col("host").cast("string")), F.lit(0))), F.lit(0))).first()
    if longest <= LIST and size <= LIST_BYTES:
        return F.broadcast(lines.groupBy(F.col("host").alias("of")).agg(F.collect_set("line").alias("frequent"))), "host"
    k, f = _keys(docs).alias("k"), lines.alias("f")
    held = k.join(f, (F.col("k.line") == F.col("f.line")) & F.col("k.host").eqNullSafe(F.col("f.host")))
    return written(held.groupBy(F.col("k.row").alias("of")).agg(F.collect_set("k.line").alias("frequent")), "held"), "row"


def _measured(docs: DataFrame, extra: list[str]) -> DataFrame:
    """Counts of each text; ``found`` has (key, words) of its lines. Arrays used again stand in a projection of their own."""
    d = docs.select(*extra, "doc_id", _row(), F.col("source").alias("host"), _text().alias("text"))
    d = d.select(*extra, "doc_id", "row", "host", F.array_remove(F.split("text", WS), "").alias("words"), _lines(F.col("text")).alias("lines"),
                 (F.length("text") - F.length(F.translate("text", SPACES, ""))).alias("n_spaces"), F.length("text").alias("n_points"),
                 (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"))
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    words = lambda x: F.length(F.regexp_replace(F.regexp_replace(x, WORD, "x"), WS, "")).cast("long")
    found = F.transform("lines", lambda x: F.struct(_line_key(x).alias("key"), words(x).alias("words")))
    d = d.select(*extra, "doc_id", "row", "host", n.cast("long").alias("n_words"), (F.col("n_points") - F.col("n_spaces")).cast("long").alias("word_chars"), "n_symbols",
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), found.alias("found"), windows.alias("windows"))
    # only texts with an equal pair of windows sort them; the places of equal ones then lie side by side
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("sorted", F.when(again, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twin = lambda e, k: (F.get("sorted", k + 1)["x"] == e["x"]) | (F.get("sorted", k - 1)["x"] == e["x"])
    d = d.withColumn("places", F.sort_array(F.transform(F.filter("sorted", lambda e, k: F.coalesce(twin(e, k), F.lit(False))), lambda e: e["i"])))
    step = F.transform("places", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - x, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    # the number is a barrier: a filter on the result would else be pushed down here and unfold the arrays into each other
    return d.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, repeated)).drop("windows", "sorted", "places")


def _judged(docs: DataFrame, extra: list[str]) -> DataFrame:
    """What ``judge`` gives, the columns of extra, and the frequent lines of the document's host."""
    lists, key = _lists(docs)
    d = _measured(docs, extra).alias("d").join(lists.alias("f"), F.col(f"d.{key}").eqNullSafe(F.col("f.of")), "left").select("d.*", "f.frequent")
    hit = F.filter("found", lambda x: F.array_contains("frequent", x["key"]))
    d = d.withColumn("n_removed_words", F.coalesce(F.aggregate(hit, F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words")))
    return d.select(*extra, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_removed_words", (~failed & ~depleted).alias("kept"), "frequent")


def judge(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, n_removed_words (of frequent lines), kept: the digest of ``keep``."""
    return _judged(docs, []).drop("frequent")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, their text without the frequent lines; the other columns (a count of characters too) as they were."""
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    kept = _judged(whole, ["__row"]).filter("kept")
    left = F.filter(F.split("__row.text", "\n"), lambda x: ~F.array_contains("frequent", _line_key(x)))
    text = F.when(F.col("n_removed_words") > 0, F.array_join(left, "\n")).otherwise(F.col("__row.text"))
    return kept.select(*[text.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return judge(docs)


SQL = rf"""
with d as (
  select row_number() over () as rn, doc_id, source as host, coalesce(text, '') as text from documents),
m as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
w as (
  select rn, i, words[i:i + {WINDOW - 1}] as w from (select rn, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) as i from m)),
covered as (
  select rn, count(distinct i + j) as n from (select rn, i, count(*) over (partition by rn, w) as k from w), (select unnest(generate_series(0, {WINDOW - 1})) as j)
  where k > 1 group by rn),
l as (
  select rn, host, line, trim(regexp_replace(translate(line, '{UPPER}', '{LOWERED}'), '{WS}', ' ', 'g')) as key
  from (select rn, host, unnest(lines) as line from m)),
f as (
  select c.host, key from (select host, key, count(distinct rn) as k from l group by host, key) c where k > {LINE_DOCS}),
gone as (
  select rn, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) as gone from l join f on l.host is not distinct from f.host and l.key = f.key group by rn),
s as (
  select m.doc_id, len(words)::bigint as n_words, len(regexp_replace(text, '{WS}', '', 'g'))::bigint as word_chars,
         (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(gone, 0)::bigint as n_removed_words
  from m left join covered c using (rn) left join gone using (rn)),
b as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
       not base_failed and not (n_removed_words > 0 and (n_words - n_removed_words < {LEFT_WORDS} or n_words - n_removed_words < {LEFT_SHARE} * n_words)) as kept
from b
"""
