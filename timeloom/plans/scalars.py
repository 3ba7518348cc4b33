"""Queries of projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates as C
from . import adapter as A
from .adapter import CAND_SQL, RAW_SQL, table

_WORDS = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_PRON = ", ".join(f"'{w}'" for w in T.PRONOUNS)


def hhmmss(spark, sf):
    c = A.candidates(spark, sf)
    return c.select("candidate_id", T.hhmmss(F.col("start_ms")).alias("start_text"), T.hhmmss(F.col("start_ms") * 50 - 1000).alias("long_text"))


HMS = lambda e: f"""(CASE WHEN greatest({e}, 0) // 3600000 > 0 THEN format('{{}}:{{:02d}}:{{:02d}}', greatest({e}, 0) // 3600000, greatest({e}, 0) // 60000 % 60, greatest({e}, 0) // 1000 % 60)
  ELSE format('{{}}:{{:02d}}', greatest({e}, 0) // 60000, greatest({e}, 0) // 1000 % 60) END)"""  # noqa: E731
ASS = lambda e: f"""format('{{}}:{{:02d}}:{{:02d}}.{{:02d}}', (greatest({e}, 0) + 5) // 360000 // 10, (greatest({e}, 0) + 5) // 60000 % 60, (greatest({e}, 0) + 5) // 1000 % 60, (greatest({e}, 0) + 5) // 10 % 100)"""
HHMMSS_SQL = f"WITH {CAND_SQL} SELECT candidate_id, {HMS('start_ms')} AS start_text, {HMS('(start_ms * 50 - 1000)')} AS long_text FROM cand"


def caption_times(spark, sf):
    c = A.candidates(spark, sf)
    return c.select("candidate_id", T.caption_time(F.col("start_ms")).alias("start_text"), T.caption_escape(F.concat(F.lit("{a}\\b\n"), "reason")).alias("escaped"))


CAPTION_TIMES_SQL = f"""WITH {CAND_SQL} SELECT candidate_id, {ASS('start_ms')} AS start_text,
  replace(replace(replace(replace('{{a}}' || chr(92) || 'b' || chr(10) || reason, chr(92), chr(92) || chr(92)), '{{', '('), '}}', ')'), chr(10), ' ') AS escaped FROM cand"""


def _urls(spark, sf):
    u = table(spark, sf, "pages").select("page_id", "url")
    hosts = {1: "https://www.youtube.com/watch?v=a", 2: "https://youtu.be/b", 3: "https://vimeo.com/9#x", 4: "ftp://x y", 5: " HTTPS://A.b/c?d#e?f "}
    made = F.col("url")
    for k, v in hosts.items():
        made = F.when(F.col("page_id") % 7 == k, F.lit(v)).otherwise(made)
    return u.withColumn("url", made)


_URLS_SQL = """urls AS (SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'https://www.youtube.com/watch?v=a' WHEN 2 THEN 'https://youtu.be/b' WHEN 3 THEN 'https://vimeo.com/9#x'
  WHEN 4 THEN 'ftp://x y' WHEN 5 THEN ' HTTPS://A.b/c?d#e?f ' ELSE url END AS url FROM pages)"""


def deep_links(spark, sf):
    return _urls(spark, sf).select("page_id", T.deep_link(F.col("url"), F.col("page_id") * 1700 - 2000).alias("link"))


DEEP_LINKS_SQL = f"""WITH {_URLS_SQL}, p AS (SELECT page_id, url, CAST(greatest(page_id * 1700 - 2000, 0) // 1000 AS VARCHAR) AS n,
  lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, CASE WHEN regexp_matches(url, '^[^#?]*\\?[^#]') THEN '&' ELSE '?' END AS j FROM urls)
SELECT page_id, CASE WHEN regexp_matches(host, 'youtube\\.com|youtu\\.be') THEN url || j || 't=' || n || 's' WHEN regexp_matches(host, 'vimeo\\.com') THEN url || '#t=' || n || 's' ELSE url || j || 't=' || n END AS link FROM p"""


def valid_urls(spark, sf):
    return _urls(spark, sf).select("page_id", T.valid_url(F.col("url")).alias("valid"))


VALID_URLS_SQL = f"WITH {_URLS_SQL} SELECT page_id, regexp_matches(trim(url), '^(?i:https?)://[^ \\t\\n\\r]+$') AS valid FROM urls"


def names(spark, sf):
    s = table(spark, sf, "supplier")
    odd = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("..a b/"), "s_name", F.lit("--"))).when(F.col("s_suppkey") % 3 == 1, F.lit("  ")).otherwise(F.col("s_name"))
    return s.select("s_suppkey", T.project_name(odd).alias("project"), T.safe_name(odd).alias("safe"))


NAMES_SQL = """WITH n AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '..a b/' || s_name || '--' WHEN 1 THEN '  ' ELSE s_name END AS x FROM supplier)
SELECT s_suppkey, CASE WHEN trim(x) = '' THEN 'default' WHEN regexp_matches(trim(x), '^[A-Za-z0-9][A-Za-z0-9._-]{0,62}$') THEN trim(x) END AS project,
  coalesce(nullif(substring(regexp_replace(regexp_replace(x, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 80), ''), 'file') AS safe FROM n"""

_LOGS = [
    "ok", "WARNING: x\nERROR: Sign in to confirm you are old", "http error 429", "ERROR: Private Video\n", "error: age-restricted", "Video unavailable\n\n  ", "Unsupported URL: x",
    "[Errno 101] Network is unreachable", "", "last line\nERROR a\nthen this",
]


def classify_errors(spark, sf):
    logs = F.array(*[F.lit(x) for x in _LOGS])
    e = table(spark, sf, "events").filter("event_type = 'error'").select("event_id", F.get(logs, (F.col("event_id") % len(_LOGS)).cast("int")).alias("log"))
    return e.select("event_id", T.classify_error(F.col("log")).alias("category"), T.last_error(F.col("log")).alias("tail"))


_ALL_LOGS = "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in _LOGS) + "]"
CLASSIFY_SQL = f"""WITH l AS (SELECT event_id, {_ALL_LOGS}[event_id % {len(_LOGS)} + 1] AS log FROM events WHERE event_type = 'error'),
p AS (SELECT event_id, log, list_filter(list_transform(string_split(log, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM l)
SELECT event_id, CASE {" ".join(f"WHEN regexp_matches(log, '(?i){p}') THEN '{n}'" for n, p in T.ERROR_RULES)} ELSE 'other' END AS category,
  substring(coalesce(list_filter(ls, lambda x: contains(x, 'ERROR') OR contains(x, 'error'))[-1], ls[-1], 'no output'), 1, 400) AS tail FROM p"""


def cold_open(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.first_word(F.col("text")).alias("first_word"), T.cold_open(F.col("text"), F.col("doc_id") * 977 % 20000).alias("warning"))


COLD_OPEN_SQL = f"""WITH w AS (SELECT doc_id, regexp_replace(lower(string_split(trim(text), ' ')[1]), '[^a-z'']', '', 'g') AS first_word FROM documents)
SELECT doc_id, first_word, CASE WHEN first_word IN ({_PRON}) THEN 'reference' WHEN doc_id * 977 % 20000 < 8000 THEN 'intro' ELSE '' END AS warning FROM w"""


def content_words(spark, sf):
    w = F.array_sort(T.content_words(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("bigint").alias("n"), F.array_join(w, " ").alias("words"))


CONTENT_WORDS_SQL = f"""WITH w AS (SELECT doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z'']{{3,}}')), lambda x: x NOT IN ({_WORDS}))) AS ws FROM documents)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, array_to_string(ws, ' ') AS words FROM w"""


def label_params(spark, sf):
    return C.with_label_params(A.candidates(spark, sf).withColumn("label", F.when(F.col("candidate_id") % 5 == 0, F.lit("unknown")).otherwise(F.col("label")))).select(
        "candidate_id", "label", "reframe", "trim", "caption_style", "silence_db", "pad_ms", "max_ms")


_LABEL_ROWS = ", ".join(f"('{k}', '{v[0]}', '{v[1]}', '{v[2]}', {v[3]}, {v[4]}, {v[5] * 1000})" for k, v in C.LABELS.items())
PARAMS_SQL = f"params(l, reframe, trim, caption_style, silence_db, pad_ms, max_ms) AS (VALUES {_LABEL_ROWS})"
LABEL_PARAMS_SQL = f"""WITH {CAND_SQL}, {PARAMS_SQL}, c AS (SELECT candidate_id, CASE WHEN candidate_id % 5 = 0 THEN 'unknown' ELSE label END AS label FROM cand)
SELECT candidate_id, label, reframe, trim, caption_style, CAST(silence_db AS BIGINT) AS silence_db, CAST(pad_ms AS BIGINT) AS pad_ms, CAST(max_ms AS BIGINT) AS max_ms
FROM c JOIN params ON l = CASE WHEN label IN (SELECT l FROM params) THEN label ELSE 'quote' END"""


def html_text(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.md5(T.html_escape(F.col("html"))).alias("escaped"), F.md5(T.html_unescape(T.html_escape(F.col("html")))).alias("back"), F.md5(T.html_unescape(F.col("html"))).alias("plain"))


def _replaced(x, pairs):
    for a, b in pairs:
        a, b = (y.replace("'", "''") for y in (a, b))
        x = f"replace({x}, '{a}', '{b}')"
    return x


_ESC = lambda x: _replaced(x, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")))
_UNESC = lambda x: _replaced(x, (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")))
HTML_SQL = f"SELECT page_id, md5({_ESC('html')}) AS escaped, md5({_UNESC(_ESC('html'))}) AS back, md5({_UNESC('html')}) AS plain FROM pages"


def html_entities(spark, sf):
    """Every named entity, by a pandas UDF; rows only."""
    return table(spark, sf, "pages").select("page_id", F.length(T.html_unescape_all(F.col("html"))).alias("n_chars"))


def human_sizes(spark, sf):
    n = (F.col("o_orderkey") * F.col("o_orderkey") * 3571) % 9_000_000_000
    n = F.when(F.col("o_orderkey") % 4 == 0, n % 2000).when(F.col("o_orderkey") % 4 == 1, n % 2_000_000).otherwise(n)
    return table(spark, sf, "orders").select("o_orderkey", T.human_size(n).alias("size_text"))


_TENTHS = lambda u: f"((n * 20 + {u}) // {2 * u})"
HUMAN_SQL = f"""WITH s AS (SELECT o_orderkey, o_orderkey * o_orderkey * 3571 % 9000000000 AS m FROM orders),
r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN m % 2000 WHEN 1 THEN m % 2000000 ELSE m END AS n FROM s)
SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' {" ".join(f"{w} {_TENTHS(u)} // 10 || '.' || {_TENTHS(u)} % 10 || ' {k}'" for w, u, k in (("WHEN n < 1048576 THEN", 1 << 10, "KB"), ("WHEN n < 1073741824 THEN", 1 << 20, "MB"), ("ELSE", 1 << 30, "GB")))} END AS size_text FROM r"""


def crop_dims(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 37 % 2000).alias("w"), (F.col("p_partkey") * 91 % 1200).alias("h"))
    w, h = T.clamped(F.col("w"), F.when(F.col("p_partkey") % 9 == 0, F.lit(0)).otherwise(F.col("h")))
    return p.select("p_partkey", w.alias("width"), h.alias("height"), T.crop_width(w, h).alias("crop"), T.crf(F.col("w") * 20).alias("crf"))


CROP_SQL = """WITH p AS (SELECT p_partkey, p_partkey * 37 % 2000 AS w, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_partkey * 91 % 1200 END AS h FROM part),
q AS (SELECT p_partkey, w AS w0, CASE WHEN w > 0 AND h > 0 THEN w ELSE 1280 END AS width, CASE WHEN w > 0 AND h > 0 THEN h ELSE 720 END AS height FROM p)
SELECT p_partkey, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST(greatest(least(height * 9 // 16, width) // 2 * 2, 2) AS BIGINT) AS crop, CAST(CASE WHEN w0 * 20 <= 20000 THEN 21 ELSE 23 END AS BIGINT) AS crf FROM q"""


def iso_times(spark, sf):
    return A.candidates(spark, sf).select("candidate_id", T.iso(F.col("start_ms") * 601).alias("at"), T.token_estimate(F.col("reason")).alias("tokens"))


ISO_SQL = f"WITH {CAND_SQL} SELECT candidate_id, strftime(make_timestamp(start_ms * 601000), '%Y-%m-%dT%H:%M:%SZ') AS at, CAST(greatest(1, length(reason) // 4) AS BIGINT) AS tokens FROM cand"


def validate_candidates(spark, sf):
    return C.validate(A.raw_candidates(spark, sf).withColumn("label", F.when(F.col("k") % 13 == 0, F.lit("what")).otherwise(F.concat(F.lit(" "), F.upper("label")))), F.lit(A.TIMELINE_MS)).select("candidate_id", "error_code", "label", "score")


_ERROR = """CASE WHEN start_ms IS NULL OR end_ms IS NULL THEN 'not_numeric' WHEN end_ms <= start_ms THEN 'inverted' WHEN start_ms < 0 OR end_ms > 2593000 THEN 'outside' WHEN end_ms - start_ms < 3000 THEN 'too_short'
  WHEN end_ms - start_ms > 180000 THEN 'too_long' WHEN label NOT IN ('quote', 'joke', 'story', 'argument', 'hot_take', 'reaction') THEN 'unknown_label' END"""
VALIDATE_SQL = f"""WITH {RAW_SQL}, r AS (SELECT candidate_id, start_ms, end_ms, CASE WHEN k % 13 = 0 THEN 'what' ELSE label END AS label, score FROM raw)
SELECT candidate_id, {_ERROR} AS error_code, label, least(10.0::DOUBLE, greatest(0.0::DOUBLE, score)) AS score FROM r"""


#: What stands in a submitted candidate instead of a good field, by ``k % 16``.
_BAD = {1: ("'[1, 2]'", "not_object"), 2: ("'{\"start\": \"x\", \"end\": 5}'", "not_numeric"), 3: ("'{\"start\": 1}'", "not_numeric"), 4: ("'{\"start\": \"NaN\", \"end\": 5}'", "not_finite"), 5: ("'{\"start\": 5, \"end\": \"Infinity\"}'", "not_finite"),
        6: ("'{broken'", "not_object"), 7: ("'{\"start\": 1, \"end\": 9, \"label\": \"quote\", \"score\": null}'", "bad_score"), 8: ("'{\"start\": 1, \"end\": 9, \"label\": \" Quote\\\\t\", \"score\": \"high\"}'", "bad_score"), 9: ("'{\"start\": 1, \"end\": 9, \"label\": \"joke\", \"cues\": [1]}'", "bad_cues")}


def submitted_candidates(spark, sf):
    """Candidates as JSON, some of them not as they should be."""
    c = A.raw_candidates(spark, sf)
    good = F.concat(F.lit('{"start": "'), (F.col("start_ms") / 1000).cast("string"), F.lit('", "end": '), (F.col("end_ms") / 1000).cast("string"), F.lit(', "label": " '), F.upper("label"), F.lit('", "score": '), F.col("score").cast("string"), F.lit(', "reason": " r\\t", "cues": {"text": true}}'))
    raw = good
    for k, (text, _) in _BAD.items():
        raw = F.when(F.col("k") % 16 == k, F.expr(text)).otherwise(raw)
    rows = C.validate(C.parse_candidates(c.select("candidate_id", raw.alias("raw"))), F.lit(A.TIMELINE_MS))
    ok = F.col("error_code").isNull()
    return rows.select("candidate_id", "error_code", *[F.when(ok, F.col(c)).alias(c) for c in ("start_ms", "end_ms", "label", "score", "reason")])


SUBMITTED_SQL = f"""WITH {RAW_SQL}, r AS (SELECT *, CASE k % 16 {" ".join(f"WHEN {k} THEN '{code}'" for k, (_, code) in _BAD.items())} ELSE {_ERROR} END AS error_code FROM raw)
SELECT candidate_id, error_code, CASE WHEN error_code IS NULL THEN start_ms END AS start_ms, CASE WHEN error_code IS NULL THEN end_ms END AS end_ms, CASE WHEN error_code IS NULL THEN label END AS label,
  CASE WHEN error_code IS NULL THEN least(10.0::DOUBLE, greatest(0.0::DOUBLE, score)) END AS score, CASE WHEN error_code IS NULL THEN 'r' END AS reason FROM r"""


def validate_batches(spark, sf):
    raw = A.raw_candidates(spark, sf).withColumn("batch", F.concat_ws("-", "source_id", F.expr("candidate_id % 3")))
    return C.validate_batches(C.validate(raw, F.lit(A.TIMELINE_MS)), "batch", "candidate_id")


BATCHES_SQL = f"""WITH {RAW_SQL}, r AS (SELECT candidate_id, source_id || '-' || (candidate_id % 3) AS batch, {_ERROR} AS error_code FROM raw)
SELECT batch, count(*) AS n, min(candidate_id) FILTER (WHERE error_code IS NOT NULL) AS first_bad, count(*) <= 50 AND count(error_code) = 0 AS accepted FROM r GROUP BY batch"""


def markers(spark, sf):
    words = A.long_words(spark, sf).withColumn("w", F.when(F.col("seq") % 97 == 0, F.get(F.array(*map(F.lit, ("[Laughter]", "[APPLAUSE]", "[music]", "[noise]"))), (F.col("seq") % 4).cast("int"))).otherwise(F.col("w")))
    spans = F.col("start_ms").alias("t")
    found = words.filter(F.col("w").startswith("[")).select("source_id", spans, F.explode(F.regexp_extract_all("w", F.lit(T.MARKERS), F.lit(0))).alias("m"))
    return found.groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_set(F.lower("m"))), ",").alias("markers"))


MARKERS_SQL = f"""WITH {A.LONG_SQL}, m AS (SELECT source_id, ['[Laughter]', '[APPLAUSE]', '[music]', '[noise]'][seq % 4 + 1] AS w FROM long WHERE seq % 97 = 0)
SELECT source_id, string_agg(DISTINCT lower(w), ',' ORDER BY lower(w)) AS markers FROM m WHERE regexp_matches(w, '(?i)\\[(?:laughter|laughs|applause|music|cheering|crosstalk)\\]') GROUP BY source_id"""

QUERIES = {
    "hhmmss": (hhmmss, HHMMSS_SQL), "caption_times": (caption_times, CAPTION_TIMES_SQL), "deep_links": (deep_links, DEEP_LINKS_SQL), "valid_urls": (valid_urls, VALID_URLS_SQL),
    "project_and_safe_names": (names, NAMES_SQL), "classify_errors": (classify_errors, CLASSIFY_SQL), "cold_open": (cold_open, COLD_OPEN_SQL), "content_words": (content_words, CONTENT_WORDS_SQL),
    "label_params": (label_params, LABEL_PARAMS_SQL), "html_text": (html_text, HTML_SQL), "html_entities": (html_entities, None), "human_sizes": (human_sizes, HUMAN_SQL), "crop_dims": (crop_dims, CROP_SQL),
    "iso_times": (iso_times, ISO_SQL), "validate_candidates": (validate_candidates, VALIDATE_SQL), "submitted_candidates": (submitted_candidates, SUBMITTED_SQL), "validate_batches": (validate_batches, BATCHES_SQL), "transcript_markers": (markers, MARKERS_SQL),
}
