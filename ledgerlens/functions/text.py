"""Text functions as column expressions (Column to Column), all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as Python's splitlines knows them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Leader characters between a title and its page.
LEADERS = ".…·∙⋯․‧•"
#: The page-number token, its four forms in order.
PAGE_TOKEN = r"(?i)(?:\bpage\s*(\d{1,6})\b|\b(\d{1,6})\s*(?:/|of)\s*\d{1,6}\b|^\s*[-–—(]*\s*(\d{1,6})\s*[-–—)]*\s*$|^\s*[-–—(]*\s*([ivxlcdm]{1,12})\s*[-–—)]*\s*$)"
PAGE_STRENGTHS = (1.2, 1.1, 1.0, 0.95)
DATE_LIKE = r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"
TIME_LIKE = r"\b\d{1,2}:\d{2}\b"
VERSION_LIKE = r"(?i)\b(v|ver|version)\.?\s*\d"


def once(value: Column, body) -> Column:
    """body(value) with the value computed once: it becomes the lambda variable of a one-element array."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Strip all Unicode white space (``trim`` would strip U+0020 only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_text(c: Column) -> Column:
    """No-break space to space, soft hyphens away, white space collapsed and stripped."""
    return collapse(F.translate(c, " ­", " "))


def narrow_spaces(c: Column) -> Column:
    """Special spaces to spaces and soft hyphens away; runs stay as they are."""
    return F.translate(c, "   ­", "   ")


def normalize_hyphenation(c: Column, before_hyphen: bool = True) -> Column:
    """Join words that a line end splits; before_hyphen also drops blanks in front of the hyphen."""
    c = F.translate(c, "   ­", "   ")
    if before_hyphen:
        c = F.regexp_replace(c, r"(?U)(?<=\w)\s+(?=\w+[ \t]*-\s*\r?\n\s*\w)", "")
    c = F.regexp_replace(c, r"(?U)(?<=\w)\s*-\s*\r?\n\s*(?=\w)", "")
    c = F.regexp_replace(c, "(?<=[A-Za-zÄÖÜäöüß])\r?\n(?=[a-zäöüß])", "")
    return F.regexp_replace(c, r"[ \t]{2,}", " ")


def truncate(c: Column, size: int = 600) -> Column:
    c = strip(c)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size - 3), F.lit("..."))).otherwise(c)


def snippet_hash(*parts: Column) -> Column:
    """First 16 hex digits of SHA-1 over the non-blank parts joined by " | " ("empty" without any)."""
    filled = [F.when(strip(p.cast("string")) != "", p.cast("string")) for p in parts]
    joined = F.concat_ws(" | ", *filled)
    return F.substring(F.sha1(F.when(joined != "", joined).otherwise("empty")), 1, 16)


def chunk_starts(c: Column, size: int, overlap: int) -> Column:
    """Zero-based starts of overlapping windows; closed form, no loop."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    n, step = F.length(c), size - overlap
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / F.lit(float(step))).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda t: t * step)


def chunks(c: Column, size: int = 12000, overlap: int = 800) -> Column:
    """Array of windows of a stripped text."""
    c = strip(c)
    return F.transform(chunk_starts(c, size, overlap), lambda s: F.substr(c, s + 1, F.lit(size)))


def scrub_section_codes(c: Column) -> Column:
    return F.regexp_replace(c, r"(?iU)\b[A-E]\.\d+(\.\d+)*\b", " ")


def is_leader(c: Column) -> Column:
    """Whether a token consists of leader characters only."""
    return c.rlike("^[" + LEADERS.replace(".", r"\.") + "]+$")


def lines(c: Column) -> Column:
    return F.split(c, LINE_END, -1)


def page_token(c: Column) -> Column:
    """Struct (kind, text, strength) of a page number in a line of text, else null."""
    found = None
    for k, kind in ((4, "roman"), (3, "arabic"), (2, "arabic"), (1, "arabic")):
        text = F.regexp_extract(c, PAGE_TOKEN, k)
        hit = F.struct(F.lit(kind).alias("kind"), F.lower(text).alias("text"), F.lit(PAGE_STRENGTHS[k - 1]).alias("strength"))
        found = F.when(text != "", hit) if found is None else F.when(text != "", hit).otherwise(found)
    return found


def roman_value(c: Column) -> Column:
    """1..3999, null where the letters are no canonical roman numeral."""
    value = F.create_map(*[F.lit(x) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in p])
    digits = F.transform(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), lambda x: value[x])
    total = F.aggregate(
        F.reverse(digits),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("max")),
        lambda a, d: F.struct(F.when(d < a.max, a["sum"] - d).otherwise(a["sum"] + d).alias("sum"), F.greatest(a.max, d).alias("max")),
        lambda a: a["sum"],
    )
    canonical = F.upper(c).rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (F.length(c) > 0)
    return F.when(canonical, total)


def roman_text(n: Column) -> Column:
    """The roman numeral of 1..3999."""
    digits = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    places = [("M", "?", "?"), ("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X")]
    out = []
    for (one, five, ten), unit in zip(places, (1000, 100, 10, 1), strict=True):
        row = F.array(*[F.lit(d.replace("X", "t").replace("V", "f").replace("I", one).replace("f", five).replace("t", ten)) for d in digits])
        out.append(row[F.floor(n / unit).cast("int") % 10])
    return F.when(n.between(1, 3999), F.concat(*out))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tab_label(key: Column, title: Column) -> Column:
    return F.concat_ws(" — ", key, null_if_empty(title))
