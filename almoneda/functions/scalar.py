"""Scalar functions of the domain as Column expressions; no Python runs on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The log-spaced budget grid, legal forms dropped from company names, the namespace of URL ids, and what
#: document ids are derived from.
BUDGET_MIN, BUDGET_MAX, BUDGET_BINS = 1_000.0, 100_000_000.0, 15
LEGAL_FORMS = ("SL", "SLU", "SLL", "SA", "SAU", "SCA", "SC", "SLP", "SLNE", "SCOOP", "COOP", "SRL", "SAL", "AIE", "UTE")
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
ID_PREFIX = "https://placsp.id/"
_SPAN = math.log(BUDGET_MAX) - math.log(BUDGET_MIN)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last_segment(url) -> Column:
    """What follows the last slash, trailing slashes aside."""
    return F.substring_index(F.regexp_replace(_c(url), "/+$", ""), "/", -1)


def url_uuid5(name) -> Column:
    """UUID version 5 of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(_c(name), "utf-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def object_uuid(sid) -> Column:
    return url_uuid5(F.concat(F.lit(ID_PREFIX), _c(sid)))


def budget_bucket(amount) -> Column:
    """b00 to b14 on a log scale from 1,000 to 100 million; null for none or nothing."""
    a = _c(amount)
    step = F.floor(F.lit(BUDGET_BINS) * (F.ln(a) - F.lit(math.log(BUDGET_MIN))) / F.lit(_SPAN)).cast("int")
    name = lambda n: F.format_string("b%02d", n)
    return F.when(a.isNull() | (a <= 0), F.lit(None)).when(a < BUDGET_MIN, F.lit("b00")).when(a >= BUDGET_MAX, F.lit("b14")).otherwise(name(F.least(step, F.lit(14))))


def log_scale_pos(value) -> Column:
    v = F.coalesce(F.nullif(_c(value), F.lit(0.0)), F.lit(BUDGET_MIN))
    return (F.ln(F.least(F.greatest(v, F.lit(BUDGET_MIN)), F.lit(BUDGET_MAX))) - F.lit(math.log(BUDGET_MIN))) / F.lit(_SPAN)


def log_scale_value(pos) -> Column:
    t = F.least(F.greatest(_c(pos), F.lit(0.0)), F.lit(1.0))
    return F.floor(F.exp(F.lit(math.log(BUDGET_MIN)) + t * F.lit(_SPAN)) + 0.5).cast("double")


def month_of(text) -> Column:
    """The first YYYY-MM anywhere in a text."""
    return F.nullif(F.regexp_extract(_c(text), r"(\d{4}-\d{2})", 1), F.lit(""))


def normalize_date(text) -> Column:
    """RFC 3339: unchanged with a T, midnight UTC for a leading date, else null."""
    t = _c(text)
    day = F.nullif(F.regexp_extract(t, r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.when(t.isNull() | F.contains(t, F.lit("T")), t).otherwise(F.concat(day, F.lit("T00:00:00Z")))


def money(v) -> Column:
    return F.concat(F.format_number(_c(v), 2), F.lit(" EUR"))


def money_es(v) -> Column:
    """Spanish style without decimals: points between thousands, the euro sign after. Four digits go ungrouped."""
    r = F.round(_c(v), 0)
    grouped = F.translate(F.format_number(r, 0), ",", ".")
    return F.concat(F.when(F.abs(r) < 10_000, F.format_string("%d", r.cast("long"))).otherwise(grouped), F.lit(" €"))


def normalize_nif(text) -> Column:
    return F.nullif(F.upper(F.regexp_replace(_c(text), r"[\s.\-]", "")), F.lit(""))


def normalize_name(text) -> Column:
    """Company name for matching: letters and digits, upper case, lone letters joined, legal forms dropped.

    Words lie between single spaces, so a word is what no other character touches; arrays of words would be built by
    interpreted functions, several times a row.
    """
    letter, begin, end = "[A-ZÁÉÍÓÚÜÑ]", "(?<![^ ])", "(?![^ ])"
    words = F.trim(F.regexp_replace(F.upper(_c(text)), "[^A-Z0-9ÁÉÍÓÚÜÑ]+", " "))
    merged = F.regexp_replace(words, f"(?<={begin}{letter}) (?={letter}{end})", "")
    kept = F.rtrim(F.regexp_replace(merged, f"{begin}(?:{'|'.join(LEGAL_FORMS)}){end} ?", ""))
    return F.nullif(F.coalesce(F.nullif(kept, F.lit("")), merged), F.lit(""))


def is_ute(name, nif) -> Column:
    """A temporary joint venture, by its number or its name."""
    starts = lambda x, s: F.coalesce(F.upper(F.trim(_c(x))).startswith(s), F.lit(False))
    return starts(nif, "U") | starts(name, "UTE")


def _stem(digits: Column) -> Column:
    return F.regexp_replace(digits, "0+$", "")


def cpv_level(code) -> Column:
    base = F.rpad(F.split_part(_c(code), F.lit("-"), F.lit(1)), 8, "0")
    return F.greatest(F.length(_stem(base)), F.lit(2))


def cpv_prefix(code) -> Column:
    """What the codes under a node start with; the check digit after a hyphen counts as a digit."""
    d = F.rpad(F.replace(_c(code), F.lit("-"), F.lit("")), 8, "0")
    return F.substring(d, F.lit(1), F.greatest(F.length(_stem(d)), F.lit(2)))


def nuts_level(code) -> Column:
    return F.when(F.length(_c(code)) >= 5, 3).otherwise(2)


def nuts_truncate(code, level: int) -> Column:
    return F.substring(_c(code), 1, 4 if level == 2 else 5)


def shade(n, most) -> Column:
    """Step 0 to 4 of a map's scale, by the log of the count."""
    t = F.least(F.lit(1.0), F.ln(_c(n) + 1.0) / F.ln(_c(most) + 1.0))
    return F.when(_c(n) <= 0, 0).otherwise(F.least(F.floor(t * 5), F.lit(4))).cast("int")


def compact_count(n) -> Column:
    """12,3 M, 4,5 k or the number itself."""
    v = _c(n).cast("double")
    return F.when(v >= 1e6, F.format_string("%.1fM", F.floor(v / 1e5) / 10)).when(v >= 1e3, F.format_string("%.1fk", F.floor(v / 1e2) / 10)).otherwise(F.format_string("%d", _c(n).cast("long")))


def linear_pos(v, low, high) -> Column:
    span = _c(high) - _c(low)
    return F.when(span <= 0, F.lit(0.0)).otherwise(F.least(F.greatest((_c(v) - _c(low)) / F.nullif(span, F.lit(0)), F.lit(0.0)), F.lit(1.0)))


def density_path(values, width: float = 100.0, height: float = 20.0) -> Column:
    """An SVG area path over an ordered array of counts; empty for fewer than two."""
    vs = _c(values)
    n, top = F.size(vs), F.greatest(F.array_max(vs), F.lit(1))
    tenths = lambda x: (F.floor(x * 10 + 0.5) / 10).cast("decimal(9,1)").cast("string")
    point = lambda v, i: F.concat(F.lit("L "), tenths(i * F.lit(width) / (n - 1)), F.lit(" "), tenths(F.lit(height) - v * F.lit(height) / top))
    return F.when(n < 2, F.lit("")).otherwise(F.concat(F.lit(f"M 0.0 {height:.1f} "), F.array_join(F.transform(vs, point), " "), F.lit(f" L {width:.1f} {height:.1f} Z")))


def is_offpeak(ts, start: int = 22, end: int = 7) -> Column:
    h = F.hour(_c(ts))
    return (h >= start) & (h < end) if start <= end else (h >= start) | (h < end)


def spanish_number(text) -> Column:
    """The first number of a text, points between thousands and a decimal comma."""
    raw = F.regexp_extract(_c(text), r"([\d,.]+)", 1)
    return F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def clean_text(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def link_kind(name) -> Column:
    """PCAP for administrative terms, PPT for technical ones."""
    low = F.lower(_c(name))
    has = lambda *xs: F.greatest(*[F.contains(low, F.lit(x)) for x in xs]) if len(xs) > 1 else F.contains(low, F.lit(xs[0]))
    return F.when(has("administrativ", "pcap"), "PCAP").when(has("técnic", "tecnic", "ppt"), "PPT")


def strip_fences(text) -> Column:
    """A model's JSON answer without Markdown fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_c(text)), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def first_matching(urls, part: str) -> Column:
    return F.get(F.filter(_c(urls), lambda u: F.contains(u, F.lit(part))), F.lit(0))


def falsy_coalesce(*columns) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in columns])


def query_string(params: dict) -> str:
    """Query string of filter parameters: empty ones left out, lists repeated."""
    from urllib.parse import quote

    pairs = [(k, v) for k, vs in params.items() for v in (vs if isinstance(vs, (list, tuple)) else [vs]) if v not in (None, "", False)]
    return "&".join(f"{quote(str(k), safe='')}={quote(str(v).lower() if isinstance(v, bool) else str(v), safe='')}" for k, v in pairs)


def query_strings(params: dict[str, Column]) -> Column:
    """`query_string` of each row's values, by name: a column or an array of them; nulls and empty texts are left out."""
    plain = lambda c: F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))  # noqa: E731  a blank is %20
    named = lambda k: lambda x: F.concat(F.lit(f"{k}="), plain(x))
    pairs = [F.transform(F.filter(c, lambda x: x.isNotNull() & (x != "")), named(k)) for k, c in params.items()]
    return F.array_join(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in pairs]), "&")
