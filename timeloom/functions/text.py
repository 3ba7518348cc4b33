"""Column functions on strings and times; all stay within generated code."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words of the tokenizers.
PRONOUNS = "he she it they them him her his hers its their theirs this that these those we us our and but so because which who".split()
STOPWORDS = (
    "the a an and or but if then than that this these those is are was were be been "
    "being to of in on at for with as by from it its i you he she we they them his her "
    "our your my me him us do does did have has had not no yes so just like really know "
    "think would could should will can about what when there here get got one up out all "
    "very kind sort"
).split()
# Patterns of download errors, in order, with the category each tells of.
ERROR_RULES = [
    ("challenge", "sign in to confirm (you|your)"),
    ("rate_limited", "(HTTP Error 429|Too Many Requests|rate.?limit)"),
    ("private", "(private video|members-only|join this channel)"),
    ("age_restricted", "(age.?restricted|confirm your age|inappropriate for some users)"),
    ("unavailable", "(video unavailable|not available in your country|geo.?restrict)"),
    ("unsupported", "(unsupported url|is not a valid url)"),
    ("no_route", "(network is unreachable|errno 101|temporary failure in name resolution)"),
]
MARKERS = "(?i)\\[(?:laughter|laughs|applause|music|cheering|crosstalk)\\]"


# What counts as white space at the ends of a string, and what ends a line.
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
LINE_END = "\\r\\n|[\\n-\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{SPACE}++|(?<!{SPACE}){SPACE}++\\z", "")


def hhmmss(ms: Column) -> Column:
    """H:MM:SS, or M:SS below an hour; negative times are 0, fractions are cut."""
    s = F.greatest(ms, F.lit(0)).cast("bigint")
    s = F.expr("0L") + F.floor(s / 1000)
    h, m, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%d:%02d", m, rest))


def caption_time(ms: Column) -> Column:
    """H:MM:SS.cc, rounded half up to centiseconds."""
    cs = F.floor((F.greatest(ms, F.lit(0)) + 5) / 10)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def caption_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for a, b in (("{", "("), ("}", ")"), ("\n", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_unescape(text: Column) -> Column:
    """The five common entities and the no-break space."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


@F.pandas_udf(StringType())
def html_unescape_all(text):
    """Every entity that HTML names; in batches of Arrow."""
    return text.map(html.unescape, na_action="ignore")


def safe_name(text: Column, fallback: str = "file") -> Column:
    name = F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")
    name = F.substring(F.regexp_replace(name, "^[._-]+|[._-]+$", ""), 1, 80)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback))


def valid_url(url: Column) -> Column:
    return F.coalesce(strip(url).rlike("(?i)^https?://[^\\s]+$"), F.lit(False))


def project_name(name: Column, default: str = "default") -> Column:
    """The name, the default for a blank one, null for one that is not allowed."""
    name = strip(F.coalesce(name, F.lit("")))
    return F.when(name == "", F.lit(default)).when(name.rlike("^[A-Za-z0-9][A-Za-z0-9._-]{0,62}$"), name)


def classify_error(text: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(ERROR_RULES):
        out = F.when(text.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def last_error(text: Column, limit: int = 400) -> Column:
    """The last line that speaks of an error, else the last that is not blank."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), strip), lambda x: x != "")
    errors = F.filter(lines, lambda x: x.contains("ERROR") | x.contains("error"))
    return F.substring(F.coalesce(F.get(errors, F.size(errors) - 1), F.get(lines, F.size(lines) - 1), F.lit("no output")), 1, limit)


def deep_link(url: Column, start_ms: Column) -> Column:
    """A link that opens a source at a time, by the rules of its host."""
    n = F.floor(F.greatest(start_ms, F.lit(0)) / 1000).cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1), F.lit("")))
    joiner = F.when(url.rlike("^[^#?]*\\?[^#]"), F.lit("&")).otherwise(F.lit("?"))
    return (
        F.when(host.rlike("youtube\\.com|youtu\\.be"), F.concat(url, joiner, F.lit("t="), n, F.lit("s")))
        .when(host.rlike("vimeo\\.com"), F.concat(url, F.lit("#t="), n, F.lit("s")))
        .otherwise(F.concat(url, joiner, F.lit("t="), n))
    )


def first_word(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.get(F.split(F.trim(F.coalesce(text, F.lit(""))), " "), F.lit(0))), "[^a-z']", "")


def cold_open(text: Column, start_ms: Column, guard_ms: int = 8_000) -> Column:
    """'reference' if a text opens on a word without an antecedent, 'intro' if it starts in the source's opening, else ''."""
    return F.when(first_word(text).isin(PRONOUNS), F.lit("reference")).when(start_ms < guard_ms, F.lit("intro")).otherwise(F.lit(""))


def content_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z']{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOPWORDS]))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z']+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def human_size(n: Column) -> Column:
    """Bytes in B, KB, MB or GB, by 1024."""
    tenths = lambda unit: F.floor(n * 10 / unit + 0.5)
    show = lambda unit, name: F.format_string(f"%d.%d {name}", F.floor(tenths(unit) / 10), tenths(unit) % 10)
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, show(1 << 10, "KB")).when(n < 1 << 30, show(1 << 20, "MB")).otherwise(show(1 << 30, "GB"))


def token_estimate(payload: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(payload) / 4)).cast("bigint")


def stable_id(prefix: str, *keys: Column) -> Column:
    """``prefix_`` and eight hex digits that depend on the keys alone."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 8))


def fixed(x: Column, places: int) -> Column:
    """A double with so many decimals, halves to the even digit, as text; whole numbers are formatted, so that no engine's own rounding shows."""
    one = 10**places
    n = F.bround(F.abs(x) * one).cast("bigint")
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.floor(n / one).cast("string"), F.lit("."), F.lpad((n % one).cast("string"), places, "0"))


def iso(ms: Column) -> Column:
    """UTC, to the second; whatever the session's zone."""
    return F.date_format(F.timestamp_add("MILLISECOND", ms, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def crop_width(width: Column, height: Column) -> Column:
    """The even width of a 9:16 crop, 2 at least."""
    w = F.least(F.floor(height * 9 / 16), width)
    return F.greatest(w - w % 2, F.lit(2)).cast("bigint")


def crf(duration_ms: Column) -> Column:
    return F.when(duration_ms <= 20_000, F.lit(21)).otherwise(F.lit(23)).cast("bigint")


def clamped(width: Column, height: Column) -> tuple[Column, Column]:
    """Both dimensions, or 1280 by 720 unless both are known."""
    known = F.coalesce((width > 0) & (height > 0), F.lit(False))
    return F.when(known, width).otherwise(F.lit(1280)).cast("bigint"), F.when(known, height).otherwise(F.lit(720)).cast("bigint")
