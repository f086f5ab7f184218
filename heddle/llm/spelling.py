"""Spelling variants of words by a symmetric-delete join.

1. Words are counted over all texts; the vocabulary is those that are long and frequent enough.
2. Every word emits itself and its distinct single deletions as keys. Two words that differ by one inserted, deleted or
   replaced character share exactly one key, so the equi-join on keys meets each such pair once in each direction, and the
   edit distance settles which of those that meet are a pair. A key is shared by at most as many words as there are
   letters to insert into it and places for them, whatever the corpus, so no key is hot.
3. Pairs are never gathered: each task sums up what its words met, a count and the best near word, before the shuffle by word.
4. A word's form is its most frequent near word (of equals the first), if that is ``RATIO`` times as frequent as the word. Roots are found
   by joining the forms with themselves, which doubles the steps that are followed, until none changes; frequencies grow
   by ``RATIO`` with each form, so chains are short and have no cycles.

Only a number of rows comes to the driver. Words are maximal runs of ``LETTERS``, of which A-Z are lower-cased. A null text has
none. Texts of any length are split in the JVM, one row a word; repeated rows count again. Other columns are not read. No rows, and texts
without frequent words, give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Every so many words' occurrences are misspelt in words_with_slips.
SLIPS = 199
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word) for each word of each text, A-Z in lower case."""
    found = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, UPPER.lower()), F.lit(LETTERS), F.lit(0))
    return df.select(F.col(id_col).alias("id"), F.explode(found).alias("word"))


def without(word: Column, at: Column) -> Column:
    """The word without its character at a place, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def words_with_slips(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word) with slips: a word loses a character where the checksum of id and word says so. A null id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    slipped = F.when(h % SLIPS == 0, without(F.col("word"), (h % F.length("word")).cast("int"))).otherwise(F.col("word"))
    return word_rows(df, id_col, text_col).select("id", slipped.alias("word"))


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the long and frequent ones."""
    counted = words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def keys(words: DataFrame) -> DataFrame:
    """(key, word, n): each word and its distinct single deletions."""
    word = F.col("word")
    deleted = F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda k: without(word, k))
    return words.select(F.explode(F.array_distinct(F.concat(F.array(word), deleted))).alias("key"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best struct<n, word>) of the words that are one edit from another."""
    left, right = keys(words), keys(words).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = left.join(right, "key").where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    best = F.min_by(F.struct(F.col("near_n").alias("n"), F.col("near").alias("word")), F.struct(-F.col("near_n"), F.col("near")))
    return met.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last form that is reached from each word."""
    links = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        doubled = materialise(links.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        links = doubled.select("word", "root")
        if not doubled.where("moved").limit(1).count():
            return links


def variants(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each frequent one among the rows of ``words``; form and form_n are null
    and root is the word itself where it is no variant."""
    known = materialise(vocabulary(words, min_chars, min_count))
    near = near_words(known)
    best = F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best"))
    rows = known.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), best["word"].alias("form"), best["n"].alias("form_n"))
    rows = materialise(rows)
    found = rows.join(roots(rows.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = f"""
with recursive bits as (
  select b as byte, list_reduce(list_prepend(cast(b as bigint), range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as r
  from range(256) t(b)
), crc as (
  select list(r order by byte) as steps from bits
), found as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents
), runs as (
  select doc_id, run, count(*) as n from found group by all
), coded as (
  select run, n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from runs
), summed as (
  select run, n, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(len(x) // 2), lambda k: cast(('0x' || x[2 * k + 1 : 2 * k + 2]) as bigint))),
    lambda c, b: xor(c // 256, steps[xor(c, b) % 256 + 1])), 4294967295) as h
  from coded, crc
), words as (
  select case when h % {SLIPS} = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(n) as n from summed group by all
), known as (
  select word, cast(n as bigint) as n from words where length(word) >= {MIN_CHARS} and n >= {MIN_COUNT}
), cut as (
  select word, n, k, left(word, k) || substr(word, k + 2) as rest from (select word, n, unnest(range(length(word))) as k from known)
), pairs as (
  select a.word, b.word as near, b.n from cut a join cut b on a.k = b.k and a.rest = b.rest and a.word <> b.word
  union select c.word, known.word, known.n from cut c join known on c.rest = known.word
  union select known.word, c.word, c.n from cut c join known on c.rest = known.word
), best as (
  select word, count(*) as n_near, first(near order by n desc, near) as near, max(n) as near_n from pairs group by word
), formed as (
  select k.word, k.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= {RATIO} * k.n then b.near end as form, case when b.near_n >= {RATIO} * k.n then b.near_n end as form_n
  from known k left join best b on k.word = b.word
), walked as (
  select word, word as form, 0 as taken from formed
  union all
  select w.word, f.form, w.taken + 1 from walked w join formed f on w.form = f.word where f.form is not null
)
select f.word, f.form, w.root, f.n, f.n_near, f.form_n
from formed f join (select word, arg_max(form, taken) as root from walked group by word) w on f.word = w.word
"""
