"""Line dedup by distinct-site spread, with DataFrame functions only.

A line is boilerplate if it stands on ``min_sites`` or more different sites. Counting sites of every
line exactly would shuffle every (line, site) pair of the corpus, so:

1. Lines are hashed (two 64-bit hashes), and a HyperLogLog sketch of its sites is kept for each
   hash. Sketches are built on the map side and merge in the shuffle, so a line that stands in a
   third of all documents is one small row a task.
2. Where a sketch's estimate is far from the threshold, it decides: ``BAND`` relative standard
   errors on either side. Lines in between get exact distinct counts: only their (line, site)
   pairs are shuffled, distinct on the map side first.
3. Positions of boilerplate lines are joined to each document by hashes alone, gathered a document
   at a time, and turned into the stretches that stay; the text, which is shuffled once, is split and put together from
   these, in time linear in its lines.

A line must also stand in ``min_texts`` different texts, counted in the same way, so that copies of
one text on many sites do not empty each other. Every line that meets both thresholds is cut, whatever
share of a text it makes and however short it is.

Lines are compared without white space at either end; blank lines are kept. A null text stays null, a
null site is no site, repeated rows and ids are each treated alone, other columns pass through
unchanged, also those whose names begin like the ones used here, but for ``removed_col``, which is
replaced. A text of any length is split into lines in one row; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise

MIN_SITES, MIN_TEXTS = 5, 5
#: Rows of one line meet what is known of it in so many tasks at least; skewed joins are split further.
SALTS = 32
#: 2 ** LG_K registers a sketch; its relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K, BAND = 10, 8
ERROR = 1.04 / 2 ** (LG_K / 2)
BLANK = " \t\r\v\f"


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _normal(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _row_hashes(text_col: str) -> list[Column]:
    return [F.xxhash64(text_col), F.xxhash64(F.lit("row"), F.col(text_col))]


def line_rows(df: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """(h1, h2, site, r1, r2, pos) for the lines that are not blank: hashes of the line, of its site
    and of its text, which names the documents that have it."""
    r1, r2 = _row_hashes(text_col)
    site = F.when(F.col(site_col).isNotNull(), F.xxhash64(F.col(site_col).cast("string")))
    # equal lines of a document are all kept: positions are needed, not only whether one is there
    # and the text is hashed before it is taken apart, not again for each line
    whole = df.select(site.alias("site"), r1.alias("r1"), r2.alias("r2"), F.col(text_col).alias("text"))
    wide = whole.select("site", "r1", "r2", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    wide = wide.withColumn("line", _normal(F.col("line"))).where(F.length("line") > 0)
    return wide.select(*_hashes(F.col("line")), "site", "r1", "r2", "pos")


def meet(lines: DataFrame, some: DataFrame, salted_by: list[str]) -> DataFrame:
    """The line rows whose hashes are among ``some``. A line may stand in a third of all documents,
    so its rows are dealt out by other columns too, and its hashes are copied to each part."""
    salted = lines.withColumn("salt", F.pmod(F.xxhash64(*salted_by), F.lit(SALTS)))
    copies = some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(copies, ["h1", "h2", "salt"]).drop("salt")


def spread(lines: DataFrame, at_least: int, of: str) -> DataFrame:
    """(h1, h2) of the lines with so many different sites, or other values of a column."""
    h = ["h1", "h2"]
    sketched = lines.groupBy(*h).agg(F.hll_sketch_agg(of, F.lit(LG_K)).alias("sketch"))
    counted = sketched.select(*h, F.hll_sketch_estimate("sketch").alias("members"))
    counted = materialise(counted.where(F.col("members") >= at_least / (1 + BAND * ERROR) - 1))
    margin = BAND * ERROR * at_least + 1
    sure = counted.where(F.col("members") >= at_least + margin).select(*h)
    near = counted.where(F.col("members") < at_least + margin).select(*h)
    pairs = lines.where(F.col(of).isNotNull()).select(*h, F.col(of).alias("member"), "r1", "pos")
    pairs = meet(pairs, near, ["r1", "pos"]).select(*h, "member").distinct()
    exact = pairs.groupBy(*h).agg(F.count("*").alias("members")).where(F.col("members") >= at_least)
    return sure.unionAll(exact.select(*h))


def between(cut: str) -> Column:
    """Of sorted positions, the stretches (start, n) of other lines before, between and after them; the last is as long as can be."""
    at, end = F.col(cut), F.lit(1 << 30)
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda k: k + 1))
    stretch = F.zip_with(starts, F.concat(at, F.array(end)), lambda a, b: F.struct(a.alias("start"), (b - a).alias("n")))
    return F.filter(stretch, lambda r: r["n"] > 0)


def drop_boilerplate(df: DataFrame, min_sites: int = MIN_SITES, min_texts: int = MIN_TEXTS, site_col: str = "source", text_col: str = "text", removed_col: str = "n_removed") -> DataFrame:
    """``df`` with boilerplate lines cut from its texts, and the number of them as a column."""
    lines = line_rows(df, site_col, text_col)
    found = materialise(spread(lines, min_sites, "site"))
    here = materialise(meet(lines.select("h1", "h2", "r1", "r2", "pos"), found, ["r1", "pos"]).distinct())
    if min_texts > 1:
        here = here.join(spread(here, min_texts, "r1"), ["h1", "h2"])
    per = here.groupBy("r1", "r2").agg(F.array_sort(F.collect_set("pos")).alias("cut"))
    cuts = materialise(per.select("r1", "r2", F.size("cut").alias("n"), between("cut").alias("kept")))
    names = {"r1": "__heddle_c1", "r2": "__heddle_c2", "n": "__heddle_n", "kept": "__heddle_kept"}
    r1, r2 = _row_hashes(text_col)
    keyed = df.withColumns({"__heddle_r1": r1, "__heddle_r2": r2})
    same = (F.col("__heddle_r1") == F.col("__heddle_c1")) & (F.col("__heddle_r2") == F.col("__heddle_c2"))
    joined = keyed.join(cuts.withColumnsRenamed(names), same, "left")
    n, kept = F.col("__heddle_n"), F.col("__heddle_kept")
    # the text is split once: within the outer lambda its lines have a name, in the inner one an expression would be evaluated anew
    parts = lambda lines: F.flatten(F.transform(kept, lambda r: F.slice(lines, r["start"] + 1, r["n"])))
    rest = F.get(F.transform(F.array(_lines(F.col(text_col))), lambda lines: F.array_join(parts(lines), "\n")), F.lit(0))
    text = F.when(n.isNotNull(), rest).otherwise(F.col(text_col))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in df.columns if c != removed_col]
    return joined.select(*columns, F.coalesce(n, F.lit(0)).cast("long").alias(removed_col))


ORACLE = f"""
with numbered as (
  select doc_id, source, text, string_split(text, chr(10)) as parts from documents
), lines as (
  select doc_id, source, text, unnest(parts) as line, unnest(range(len(parts))) as pos from numbered
), compared as (
  select *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as t from lines
), wide as (
  select t from compared where t <> '' group by t
  having count(distinct source) >= {MIN_SITES} and count(distinct text) >= {MIN_TEXTS}
), marked as (
  select c.*, w.t is not null as bad from compared c left join wide w on c.t = w.t
), cut as (
  select doc_id, count(*) filter (bad) as n_bad,
         coalesce(string_agg(line, chr(10) order by pos) filter (not bad), '') as kept
  from marked group by doc_id
)
select d.doc_id,
       cast(coalesce(c.n_bad, 0) as bigint) as n_removed,
       cast(length(c.kept) as bigint) as n_kept_chars,
       sha256(c.kept) as text_sha256
from documents d left join cut c using (doc_id)
"""
