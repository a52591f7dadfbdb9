"""Text as columns: line layout, escaping, redaction, names and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataframe.functions.geometry import Box, hundredths

#: Advances in units of the font size, first match counts.
WHITE = r"[\s   -     　﻿]"
ADVANCES = [
    (WHITE, 0.35),
    (r"[㐀-鿿豈-﫿぀-ヿ가-힯！-｠]", 1.0),
    ("[A-Z]", 0.62),
    ("[a-z]", 0.56),
    ("[0-9]", 0.58),
    (r"\p{P}", 0.4),
]
OTHER = 0.7
MIN_FONT, MAX_FONT, MAX_TRACKING, DISPLAY, DISPLAY_SCALE, WIDTH_SAFETY, GLYPH, MIN_UNITS, BOLD = 0.1, 512.0, 36.0, 48.0, 0.78, 0.96, 0.94, 0.25, 0.12


def font_estimate(h: Column, least: float = 14.0, most: float | None = 88.0) -> Column:
    v = F.greatest(F.lit(least), h * 0.72)
    return hundredths(v if most is None else F.least(F.lit(most), v))


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)


def advance_units(line: Column) -> Column:
    """Width of a line in units of its font size: each class of characters is counted once, by what is missing without it, in hundredths."""
    n = F.length(line)
    counts = [n - F.length(F.regexp_replace(line, f"{p}++", "")) for p, _ in ADVANCES[:-1]]
    counts.append(n - F.length(F.regexp_replace(line, rf"[\p{{P}}&&[^{ADVANCES[1][0][1:-1]}]]++", "")))
    known = sum((n * round(units * 100) for n, (_, units) in zip(counts, ADVANCES, strict=True)), F.lit(0))
    return (known + (F.length(line) - sum(counts, F.lit(0))) * round(OTHER * 100)) / 100


def visible_gaps(line: Column) -> Column:
    seen = F.length(F.regexp_replace(line, WHITE, ""))
    return F.when(seen < 2, 0).otherwise(F.greatest(F.lit(0), F.length(line) - 1))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def text_style(text: Column, b: Box, glyph_w: Column, glyph_h: Column, coverage: Column, stroke: Column) -> Column:
    """(font_px, bold, tracking_px) that makes editable text fill its measured glyphs."""
    positive = lambda v, default: F.when((v > 0) & ~F.isnan(v.cast("double")) & (v < float("inf")), v).otherwise(F.lit(default))
    parts = F.transform(lines(text), lambda s: F.struct(advance_units(s).alias("units"), visible_gaps(s).alias("gaps")))
    width = positive(b.w, MIN_FONT)
    share = F.least(F.greatest(F.coalesce(F.nanvl(coverage, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    span = F.least(width, positive(glyph_w, 0.0))

    def tracked(p: Column, widest: Column, font: Column) -> Column:
        scale = F.when(font >= DISPLAY, DISPLAY_SCALE).otherwise(1.0)
        feasible = F.transform(F.filter(p, lambda x: x["gaps"] > 0), lambda x: F.greatest(F.lit(0.0), (span * WIDTH_SAFETY * (x["units"] / widest) - font * (x["units"] * scale)) / x["gaps"]))
        return F.least(F.greatest(F.coalesce(F.array_min(feasible), F.lit(0.0)), F.lit(0.0)), F.lit(MAX_TRACKING))

    def styled(p: Column, n: Column, widest: Column) -> Column:
        budget = F.least(positive(glyph_h, 1.0) / n * GLYPH, positive(b.h, MIN_FONT) / n / (1 / GLYPH), width * WIDTH_SAFETY / widest)
        bold = positive(stroke, 0.0) / (positive(glyph_h, 1.0) / n) * (1 + share) >= BOLD
        made = lambda font: F.struct(font.alias("font_px"), bold.alias("bold"), hundredths(tracked(p, widest, font)).alias("tracking_px"))
        return _let(F.least(F.greatest(hundredths(budget), F.lit(MIN_FONT)), F.lit(MAX_FONT)), made)

    measured = lambda p: F.struct(p.alias("p"), F.greatest(F.lit(1), F.size(p)).alias("n"), F.greatest(F.lit(MIN_UNITS), F.array_max(F.transform(p, lambda x: x["units"]))).alias("widest"))
    return _let(_let(parts, measured), lambda m: styled(m["p"], m["n"], m["widest"]))


def xml_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def clipped(s: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(s, 1, n)


def utf16_units(s: Column) -> Column:
    return F.octet_length(F.encode(s, "UTF-16BE")) / 2


#: Names of secrets, once lower-cased and without blanks, dots, underscores and hyphens.
SENSITIVE = [
    "authorization", "apikey", "apisecret", "accesstoken", "accesskey", "accesskeyid", "accesskeysecret",
    "secretaccesskey", "clientsecret", "credential", "password", "privatekey", "secret",
]
#: Parameters of signed addresses, hyphens and underscores aside.
SIGNED = ["signature", "accesskey", "securitytoken", "expires"]
#: Names of opaque identifiers are one of the first list followed by one of the second, or one of the third alone.
OPAQUE_OF = ["provider", "task", "request", "job", "trace", "session", "operation", "execution", "run", "correlation", "event", "opaque"]
OPAQUE_AS = ["id", "key", "token", "uuid", "reference"]
OPAQUE_ALONE = ["id", "uuid", "token"]
#: A name, lower-cased and without blanks, dots, underscores and hyphens, that is an opaque identifier's.
OPAQUE_NAME = f"(?:(?:{'|'.join(OPAQUE_OF)})(?:{'|'.join(OPAQUE_AS)})|{'|'.join(OPAQUE_ALONE)})"
#: Prefixes of headers that carry secrets.
VENDOR_HEADERS = ["x-dashscope", "x-acs", "x-aliyun", "x-alibaba", "x-oss"]


def sensitive_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), r"[\s._-]+", "").isin(SENSITIVE)


def _loosely(word: str) -> str:
    """The name with blanks, dots, underscores and hyphens anywhere."""
    return r"[\s._-]*".join(word)


def redacted(text: Column, configured: str = "") -> Column:
    """Credentials out of a text: a configured key, bearer tokens, known key shapes, assignments to sensitive names, signed URLs, vendor headers.

    The names are part of the pattern, so no function is called for each match. Longer names come first.
    """
    mark = "[REDACTED]"
    if configured:
        text = F.replace(text, F.lit(configured), F.lit(mark))
    names = "|".join(_loosely(n) for n in sorted(SENSITIVE, key=len, reverse=True))
    headers = "|".join(VENDOR_HEADERS)
    any_name = rf"(?:{names}|(?:{headers})-[^\"'\\\r\n]*)"
    for pattern in (
        r"(?i)\bbearer\s+[^\s,;}\"']+",
        r"(?i)\b(?:sk-[a-z0-9_-]{8,}|LTAI[a-z0-9]{12,})\b",
        rf"(?i)([\"'])[\s._-]*{any_name}[\s._-]*\1\s*[:=]\s*([\"'])[^\"'\\\r\n]{{0,8192}}\2",
        rf"(?i)([\"'])[\s._-]*{any_name}[\s._-]*\1\s*[:=]\s*([\"']?)(?:bearer\s+)?[^\s,;}}\"']+\2",
        rf"(?i)\b(?:{'|'.join('[._-]*'.join(n) for n in sorted(SENSITIVE, key=len, reverse=True))})[._-]*\s*[:=]\s*([\"']?)(?:bearer\s+)?[^\s,;}}\"']+\1",
    ):
        text = F.regexp_replace(text, pattern, mark)
    signed = "|".join("[-_]*".join(n) for n in SIGNED)
    text = F.regexp_replace(text, rf"(?i)https?://[^\s<>\"'?]*\?(?:[^\s<>\"'&#]*&)*[^\s<>\"'=&#]*(?:{signed})[^\s<>\"']*", "[REDACTED_URL]")
    return F.regexp_replace(text, rf"(?i)\b(?:{headers})-[a-z0-9-]+\s*[:=]\s*[^\s,;}}\"']+", mark)


def opaque_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), r"[\s._-]+", "").rlike(f"^{OPAQUE_NAME}$")


def opaque_value(v: Column) -> Column:
    """Redaction marks, addresses, identifiers and long tokens with letters and digits say nothing to a reader."""
    uuid = r"(?i)^[a-f0-9]{8}-[a-f0-9]{4}-[1-5][a-f0-9]{3}-[89ab][a-f0-9]{3}-[a-f0-9]{12}$"
    token = v.rlike(r"(?i)^[a-z0-9][a-z0-9._~+/=-]{15,}$") & v.rlike("[A-Za-z]") & v.rlike("[0-9]")
    return F.contains(v, F.lit("[REDACTED")) | v.rlike("(?i)^https?://") | v.rlike(uuid) | token


def safe_relative_path(p: Column) -> Column:
    parts = F.split(p, "/")
    return (F.length(p) > 0) & ~F.startswith(p, F.lit("/")) & ~F.contains(p, F.lit("\\")) & F.forall(parts, lambda s: ~s.isin("", ".", ".."))


def asset_name(z: Column, ident: Column) -> Column:
    return F.concat(F.lit("assets/semantic-"), F.lpad((z + 1).cast("string"), 3, "0"), F.lit("-"), F.substring(F.sha2(ident, 256), 1, 10), F.lit(".png"))


def http_failure(status: Column) -> Column:
    return (
        F.when(status.isin(401, 403), "auth_unavailable").when(status == 404, "unavailable").when(status.isin(408, 409, 429) | (status >= 500), "retryable_exhausted").otherwise("invalid_input")
    )


def inline_image(s: Column) -> Column:
    """A data address of an image, or 2,048 characters and more of base64."""
    return s.rlike(r"(?i)data:image/[a-z0-9.+-]+;base64,") | ((F.length(s) >= 2048) & (F.length(s) % 4 == 0) & s.rlike(r"^[A-Za-z0-9+/]+={0,2}$"))
