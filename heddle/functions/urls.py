"""URL and date functions as columns. A URL that can't be parsed has no host and matches nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions import fixed
from heddle.functions.text import fold, has_word, let, match_blob


def host(url: Column) -> Column:
    """Lower-case host, null if there is none."""
    found = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(found != "", found)


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def host_suffixes(name: Column) -> Column:
    """The host and every parent domain, the host first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def domain_allowed(url: Column, domains: Column, at: Column | None = None) -> Column:
    """Whether the host is one of the domains or below it. No domains allow everything. ``at``, here and below, is the
    URL ready-made by ``parsed``, for rows of which several things are asked."""
    h = host(url) if at is None else F.nullif(at["host"], F.lit(""))
    listed = F.exists(domains, lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))
    return F.when(F.size(domains) == 0, F.lit(True)).otherwise(F.coalesce(listed, F.lit(False)))


def parsed(url: Column) -> Column:
    """Host, path, query and path segments, parsed once."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    whole = F.struct(F.coalesce(host(url), F.lit("")).alias("host"), path(url).alias("path"), query.alias("query"))
    return let(whole, lambda u: F.struct(u["host"].alias("host"), u["path"].alias("path"), u["query"].alias("query"), F.filter(F.split(u["path"], "/"), lambda s: s != "").alias("segments")))


def is_article(url: Column, at: Column | None = None) -> Column:
    """Whether the URL looks like one article's: rejects in order, then the last segments decide."""
    return let(parsed(url), _is_article) if at is None else _is_article(at)


def _is_article(url: Column) -> Column:
    parts = url["segments"]
    low = F.transform(parts, F.lower)
    n = F.size(parts)
    labels = F.split(url["host"], r"\.")
    query = url["query"]
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    before = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    literal = lambda words: F.array(*map(F.lit, words))
    dashes = lambda s: F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit("")))
    digit = lambda s: s.rlike("[0-9]")
    contains_any = lambda s, words: F.exists(literal(words), lambda w: F.contains(s, w))
    reject = (
        F.arrays_overlap(labels, literal(fixed.BETTING_LABELS + fixed.SCOREBOARD_LABELS))
        | query.rlike("(^|&)page=[^&]")
        | (F.length(F.btrim(url["path"], F.lit("/"))) < 6)
        | F.arrays_overlap(low, literal(fixed.MEDIA_SEGMENTS))
        | (F.size(F.array_intersect(F.split(F.lower(last), "-"), literal(fixed.LIST_WORDS))) >= 2)
        | F.exists(low, lambda s: F.exists(literal(fixed.MEDIA_PREFIXES), lambda p: s.startswith(p)))
        | last.rlike("^(19|20)[0-9]{2}$")
        | contains_any(last, fixed.PREMATCH_MARKERS + fixed.DIGEST_MARKERS + fixed.INTERACTIVE_MARKERS)
    )
    accept = F.when(n == 1, (dashes(last) >= 2) | digit(last)).otherwise(F.contains(last, F.lit("-")) | digit(last) | ((dashes(before) >= 2) & digit(before)))
    return F.coalesce(~reject & (n > 0) & accept, F.lit(False))


def _core(segment: Column) -> Column:
    """The segment without its last extension."""
    return F.regexp_replace(segment, r"\.[^.]*$", "")


def article_key(url: Column, at: Column | None = None) -> Column:
    """Key under which copies of an article at several URLs are one."""
    return let(parsed(url), _article_key) if at is None else _article_key(at)


def _article_key(url: Column) -> Column:
    h = F.regexp_replace(url["host"], r"^www\.", "")
    dotted = F.regexp_extract(url["path"], r"(\d+\.\d{6,})", 1)
    parts = url["segments"]
    cores = F.transform(parts, _core)
    number = lambda least: lambda c: c.rlike(rf"^\d{{{least},}}$")
    long_id = F.element_at(F.concat(F.array(F.lit("")), F.filter(cores, number(6))), -1)
    is_short = lambda c: c.rlike(r"^\d{4,}$") & ~c.rlike(r"^(19|20)\d\d$")
    spots = F.filter(F.transform(cores, lambda c, k: F.when(is_short(c), k)), lambda k: k.isNotNull())
    spot = F.try_element_at(spots, F.lit(-1))
    upto = F.concat(F.slice(parts, F.lit(1), spot), F.array(F.element_at(cores, spot + 1)))
    return (
        F.when(dotted != "", F.concat(h, F.lit("/id/"), dotted))
        .when(long_id != "", F.concat(h, F.lit("/id/"), long_id))
        .when(spot.isNotNull(), F.concat(h, F.lit("/"), F.array_join(upto, "/")))
        .otherwise(F.concat(h, F.lit("/"), F.array_join(parts, "/")))
    )


def url_date(url: Column) -> Column:
    """The latest date that the URL has, as an ISO string, or null."""

    def dates(pattern: str, century: str = "") -> Column:
        y, m, d = (F.regexp_extract_all(url, F.lit(pattern), F.lit(k)) for k in (1, 2, 3))
        return F.transform(F.arrays_zip(y.alias("y"), m.alias("m"), d.alias("d")), lambda x: F.concat(F.lit(century), x["y"], F.lit("-"), x["m"], F.lit("-"), x["d"]))

    return F.array_max(F.concat(dates(fixed.DATE_SLASHED), dates(fixed.DATE_COMPACT), dates(fixed.DATE_NUMBERED, "20")))


def without_dates(url: Column) -> Column:
    for pattern in (fixed.DATE_SLASHED, fixed.DATE_COMPACT, fixed.DATE_NUMBERED):
        url = F.regexp_replace(url, pattern, " ")
    return url


def iso_day(text: Column) -> Column:
    """A date from a string that begins like one, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))


def dated_before(url: Column, day: Column, margin: int, date: Column | None = None) -> Column:
    """Whether the URL's date, or the ready-made one, is more than margin days before the day; false if either lacks."""
    return F.coalesce((url_date(url) if date is None else date).try_cast("date") < F.date_sub(iso_day(day), margin), F.lit(False))


def too_old(url: Column, day: Column, date: Column | None = None) -> Column:
    return dated_before(url, day, 2, date)


def is_prematch(url: Column, day: Column, date: Column | None = None) -> Column:
    return dated_before(url, day, 1, date)


def published_before(published: Column, day: Column) -> Column:
    iso = r"^\d{4}-\d{2}-\d{2}"
    both = published.rlike(iso) & day.rlike(iso)
    return F.coalesce(both & (F.substring(published, 1, 10) < F.substring(day, 1, 10)), F.lit(False))


def day_gap(a: Column, b: Column) -> Column:
    """Days between two ISO dates, null if one isn't."""
    return F.abs(F.datediff(iso_day(a), iso_day(b)))


def _both(url: Column, title: Column) -> Column:
    """URL and title (or the other way round) as one folded text. The predicates below take it
    ready-made as ``blob``, for rows of which several are asked."""
    return match_blob(F.concat_ws(" ", url, title))


def slug_blob(url: Column, title: Column) -> Column:
    """The title and the URL without its dates, folded."""
    return _both(title, without_dates(url))


def hints_score(url: Column, title: Column, slug: Column | None = None) -> Column:
    if slug is not None:
        return F.coalesce(slug.rlike(fixed.URL_SCORE), F.lit(False))
    return F.coalesce(_both(title, without_dates(url)).rlike(fixed.URL_SCORE), F.lit(False))


def mentions_final_score(score: Column, url: Column, title: Column, slug: Column | None = None) -> Column:
    """Whether the slug or title has the score, in either orientation, compared as numbers."""
    final = r"^\s*(\d{1,2})\s*[-:]\s*(\d{1,2})\s*$"
    a, b = (F.regexp_extract(score, final, k).try_cast("int") for k in (1, 2))
    blob = slug_blob(url, title) if slug is None else slug
    x, y = (F.regexp_extract_all(blob, F.lit(fixed.URL_SCORE), F.lit(k)) for k in (1, 2))
    same = F.exists(F.arrays_zip(x, y), lambda p: ((p["0"].cast("int") == a) & (p["1"].cast("int") == b)) | ((p["0"].cast("int") == b) & (p["1"].cast("int") == a)))
    return F.coalesce(same, F.lit(False))


def hints_report(url: Column, title: Column, blob: Column | None = None) -> Column:
    return has_word(_both(title, url) if blob is None else blob, fixed.REPORT)


def is_opinion(url: Column, title: Column, blob: Column | None = None) -> Column:
    return has_word(_both(url, title) if blob is None else blob, fixed.OPINION)


def is_roundup(url: Column, title: Column, blob: Column | None = None) -> Column:
    return has_word(_both(url, title) if blob is None else blob, fixed.ROUNDUP)


def is_ranking(url: Column, title: Column, blob: Column | None = None) -> Column:
    return has_word(_both(url, title) if blob is None else blob, fixed.RANKING)


def is_social(url: Column, title: Column, blob: Column | None = None) -> Column:
    return has_word(_both(url, title) if blob is None else blob, fixed.SOCIAL)


def is_non_reaction(url: Column, title: Column, blob: Column | None = None) -> Column:
    return has_word(_both(url, title) if blob is None else blob, fixed.ROUNDUP + fixed.RANKING + fixed.SOCIAL)


def is_other_section(url: Column) -> Column:
    """Whether a path segment names a section that isn't sports, and none names sports."""
    literal = lambda words: F.array(*map(F.lit, words))
    return let(F.split(fold(path(url)), "/"), lambda parts: ~F.arrays_overlap(parts, literal(fixed.SPORTS_SEGMENTS)) & F.arrays_overlap(parts, literal(fixed.OTHER_SEGMENTS)))


def tribute_phrases(aliases: tuple[str, ...]) -> tuple[str, ...]:
    """A verb of defeat with an own alias as its object."""
    from heddle.functions.text import fold_python

    names = [a for a in (fold_python(x).replace("-", " ").replace("_", " ") for x in aliases) if len(a) >= 3]
    return tuple(f"{v} {a}" for v in fixed.TRIBUTE_VERBS for a in names)


def is_tribute(url: Column, title: Column, aliases: tuple[str, ...], blob: Column | None = None) -> Column:
    return has_word(_both(title, url) if blob is None else blob, tribute_phrases(aliases))


def has_match_context(url: Column, title: Column, own: tuple[str, ...], opponent: tuple[str, ...], signals: tuple[str, ...], blob: Column | None = None) -> Column:
    """Whether a hit may be on the match: the opponent is named, or the own team is as a word, or
    isn't at all; if only inside a word, a signal word, the year or a score is needed."""
    from heddle.functions.text import fold_python, has_part

    folded = lambda names: tuple(fold_python(x) for x in names if len(x) >= 3)
    signal = lambda b: has_word(b, (*map(fold_python, signals), "2026")) | F.coalesce(b.rlike(fixed.URL_SCORE), F.lit(False))
    met = lambda b: has_part(b, folded(opponent)) | has_word(b, folded(own)) | ~has_part(b, folded(own)) | signal(b)
    return let(_both(title, url), met) if blob is None else met(blob)


def fetch_outcome(status: Column, message: Column) -> Column:
    """Class of a failed fetch, by HTTP status, else by the message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status.isin(*fixed.BOT_BLOCK), "botblock")
        .when(status.isin(*fixed.STALE_PATH), "stale_path")
        .when((status == 429) | (status >= 500), "transient")
        .when(F.contains(low, F.lit("pusta tresc")), "empty")
        .when(low.rlike("timeout|timed out|connect|network"), "transient")
        .otherwise("error")
    )


def search_outcome(message: Column) -> Column:
    low = F.lower(message)
    return F.when(F.contains(message, F.lit("432")), "432").when(low.rlike("timeout|timed out|connect"), "transient").otherwise("error")
