"""Text rules of notes as Columns: all stay in Catalyst.

JavaScript's white space is wider than Java's, and its ``$`` is the end of the input only;
patterns here say so by ``BLANK`` and ``\\z``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, as the inside of a character class.
BLANK = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Any character but a line end.
DOT = r"[^\n\r\x{2028}\x{2029}]"
# The patterns of fences and of inline code.
_FENCE = r"(?:\A|(?<=\n))[\t ]*(```|~~~)[^\n]*(?:\n[\s\S]*?(?:(?<=\n)[\t ]*\1[\t ]*(?:\n|\z)|\z)|\z)"
_CODE = r"|`[^`\n]+`"

# Prefixes that mark a payload inside code.
LINK_PREFIX = "page-link:"
MATH_INLINE = "latex-math-inline:"
MATH_BLOCK = "latex-math-block"
METADATA_FENCE = "page-metadata"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def js_trim(col: Column) -> Column:
    return F.regexp_replace(col, rf"\A[{BLANK}]+|[{BLANK}]+\z", "")


def normalize_newlines(col: Column) -> Column:
    return F.replace(col, F.lit("\r\n"), F.lit("\n"))


def strip_quotes(col: Column) -> Column:
    """One outer quote less on either side."""
    return F.regexp_replace(col, r"""\A["']|["']\z""", "")


def insert_after_frontmatter(content: Column, block: Column) -> Column:
    """After the closing ``---`` line, else on top."""
    return bound(content, lambda c: _inserted(c, block))


def _inserted(content: Column, block: Column) -> Column:
    end = F.locate("\n---", content, 5)  # from offset 4
    rest = F.substring(content, end + 4, F.length(content))
    after = F.locate("\n", rest)
    line_end = F.when(after > 0, end + 3 + after).otherwise(F.length(content))
    framed = F.concat(F.substring(content, F.lit(1), line_end), F.lit("\n"), block, F.lit("\n"), F.substring(content, line_end + 1, F.length(content)))
    return F.when(content.startswith("---\n") & (end > 0), framed).otherwise(F.concat(block, F.lit("\n\n"), content))


# --- code protection ---------------------------------------------------------------------


def _cut(col: Column, pattern: str) -> Column:
    """Alternately what stands between the matches of ``pattern``, and the matches."""
    marked = F.split(F.regexp_replace(col, pattern, "\x01$0\x01"), "\x01", -1)
    between, found = F.split(col, pattern, -1), F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(between, found, lambda t, c: F.filter(F.array(t, c), lambda x: x.isNotNull()))
    return F.when(col.contains("\x01"), F.flatten(pairs)).otherwise(marked)


def _may_hold_code(col: Column) -> Column:
    return col.contains("`") | col.contains("~~~")


def segment(col: Column) -> Column:
    """Parts of a text: even ones are text, odd ones code (fences and inline code)."""
    return bound(col, lambda c: F.when(_may_hold_code(c), _cut(c, _FENCE + _CODE)).when(c.isNotNull(), F.array(c)))


def fence_parts(col: Column) -> Column:
    """Like ``segment``, with fences only."""
    return bound(col, lambda c: F.when(c.contains("```") | c.contains("~~~"), _cut(c, _FENCE)).when(c.isNotNull(), F.array(c)))


def join_parts(parts: Column) -> Column:
    return F.array_join(parts, "")


def over_text(parts: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` over the text parts of a segmented text; code stays."""
    return F.transform(parts, lambda x, i: F.when(i % 2 == 0, fn(x)).otherwise(x))


def settle(parts: Column) -> Column:
    """What ``segment`` would make of the joined parts, after a pass over the text parts.

    Where no text part holds a sign of code, the parts are already that: code starts
    nowhere else, and no pass takes the line end before a fence away. Inline code that
    the pass has put into a text part is cut out of it there. Only where signs are
    left over is the joined text segmented anew."""

    def finer(x: Column, i: Column) -> Column:
        return F.when((i % 2 == 1) | ~x.contains("`"), F.array(x)).otherwise(_cut(x, _CODE[1:]))

    def left_over(p: Column) -> Column:
        return F.exists(F.transform(p, lambda x, i: (i % 2 == 0) & _may_hold_code(x)), lambda x: x)

    cut = lambda p: F.flatten(F.transform(p, finer))
    whole = lambda p: bound(cut(p), lambda c: F.when(left_over(c), segment(join_parts(c))).otherwise(c))
    return bound(parts, lambda p: F.when(left_over(p), whole(p)).otherwise(p))


def transform_text(col: Column, fn: Callable[[Column], Column]) -> Column:
    """Apply ``fn`` to the text parts and put the parts together again."""
    return join_parts(over_text(segment(col), fn))


def _without_comments(x: Column) -> Column:
    return F.when(x.contains("%%"), F.regexp_replace(x, r"%%[\s\S]*?%%", "")).otherwise(x)


def strip_comment_parts(parts: Column) -> Column:
    """``strip_comments`` from parts to parts."""
    return settle(over_text(parts, _without_comments))


def strip_comments(col: Column) -> Column:
    """Remove ``%%...%%`` within each text part."""
    return bound(col, lambda c: F.when(c.contains("%%"), transform_text(c, _without_comments)).otherwise(c))


def _with_escaped_gt(x: Column) -> Column:
    def row(line: Column) -> Column:
        return F.when(F.regexp_like(line, F.lit(rf"\|{DOT}*\|")), F.regexp_replace(line, r"(\|[\t ]*)>", r"$1\\>")).otherwise(line)

    return F.when(F.regexp_like(x, F.lit(r"\|[\t ]*>")), F.array_join(F.transform(F.split(x, "\n", -1), row), "\n")).otherwise(x)


def escape_table_gt_parts(parts: Column) -> Column:
    """``escape_table_gt`` from parts to parts. It makes no code."""
    return over_text(parts, _with_escaped_gt)


def escape_table_gt(col: Column) -> Column:
    """``|  >`` becomes ``|  \\>`` on lines with two pipes."""
    return bound(col, lambda c: F.when(c.contains("|") & c.contains(">"), transform_text(c, _with_escaped_gt)).otherwise(c))


def _with_math(x: Column) -> Column:
    # fixed values: block math, inline math
    def math(x: Column) -> Column:
        x = F.regexp_replace(x, "[\x02\x03]", "")
        x = F.regexp_replace(x, r"\$\$([\s\S]+?)\$\$", "\x02$1\x03")
        x = F.regexp_replace(x, "\x02\n*([^\x03]*?)\n*\x03", f"\n\n```{MATH_BLOCK}\n$1\n```\n\n")
        x = F.regexp_replace(x, rf"(?<!\\)\$([^{BLANK}$](?:[^$\n]*?[^{BLANK}$])?)\$", "\x02$1\x03")
        x = F.regexp_replace(x, "\x02([^\x03]*[a-zA-Z\\\\][^\x03]*)\x03", f"`{MATH_INLINE}$1`")
        return F.regexp_replace(x, "[\x02\x03]", r"\$")

    return F.when(x.contains("$"), math(x)).otherwise(x)


def math_parts(parts: Column) -> Column:
    """``rewrite_math`` over parts. It is the last pass: what it makes is not cut out again."""
    return over_text(parts, _with_math)


def rewrite_math(col: Column) -> Column:
    """``$$..$$`` becomes a fence, ``$..$`` with a letter or backslash inline code. Both are
    first put between marks, so that a pair that is not math is still consumed."""
    return bound(col, lambda c: F.when(c.contains("$"), transform_text(c, _with_math)).otherwise(c))


# --- HTML --------------------------------------------------------------------------------


def _code_points(col: Column, pattern: str, base: int) -> Column:
    def character(digits: Column) -> Column:
        value = F.conv(digits, base, 16)
        return F.decode(F.unhex(F.lpad(value, 8, "0")), "UTF-32")

    def replaced(c: Column) -> Column:
        found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), character)
        return F.array_join(F.zip_with(F.split(c, pattern, -1), found, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")

    return bound(col, lambda c: F.when(c.contains("&#"), replaced(c)).otherwise(c))


def decode_entities(col: Column) -> Column:
    """Named entities, hexadecimal and decimal code points, ``&amp;`` last."""
    # fixed values: the names and what they mean
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        col = F.replace(col, F.lit(name), F.lit(value))
    col = F.regexp_replace(col, "&apos;|&#0*39;", "'")
    col = F.replace(col, F.lit("&nbsp;"), F.lit(" "))
    col = _code_points(col, "&#x([0-9a-fA-F]+);", 16)
    col = _code_points(col, "&#([0-9]+);", 10)
    return F.replace(col, F.lit("&amp;"), F.lit("&"))


def html_lines(col: Column) -> Column:
    """Visible lines of an HTML fragment: never empty."""
    # fixed values: the tags that end a line
    broken = F.regexp_replace(F.regexp_replace(col, rf"(?i)<br[{BLANK}]*/?>", "\n"), r"(?i)</(?:div|p)>", "\n")
    plain = decode_entities(F.regexp_replace(broken, "<[^>]+>", ""))
    lines = F.transform(F.split(plain, "\n", -1), lambda x: js_trim(F.regexp_replace(x, rf"[{BLANK}]+", " ")))
    return bound(F.filter(lines, lambda x: x != ""), lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(""))))


def html_to_lines(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """``keys``, line_no (from 0) and line, one row for each visible line."""
    return df.where(F.col(col).isNotNull()).select(*keys, F.posexplode(html_lines(F.col(col))).alias("line_no", "line"))


# --- highlights, anchors, references -----------------------------------------------------


def highlight_pairs(col: Column) -> Column:
    """Texts of the ``==x==`` spans of one text part. The first ``==`` with a non-blank
    character after it opens, the next with one before it closes."""
    pieces = F.split(col, "==", -1)

    def pairs(p: Column) -> Column:
        start = F.struct(F.lit(-1).alias("open"), F.array().cast("array<string>").alias("found"))

        def step(a: Column, i: Column) -> Column:
            before, after = F.element_at(p, i), F.element_at(p, i + 1)  # the i-th marker stands between
            closes = (a["open"] >= 0) & F.regexp_like(before, F.lit(rf"[^{BLANK}]\z"))
            opens = (a["open"] < 0) & F.regexp_like(after, F.lit(rf"\A[^{BLANK}]"))
            inner = F.array_join(F.slice(p, a["open"] + 1, i - a["open"]), "==")
            return F.struct(
                F.when(closes, -1).when(opens, i).otherwise(a["open"]).alias("open"),
                F.when(closes, F.concat(a["found"], F.array(inner))).otherwise(a["found"]).alias("found"),
            )

        markers = F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(markers, start, step, lambda a: a["found"])

    return bound(pieces, pairs)


def highlight_spans(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """``keys``, part, pos and span: highlights in text, code is never scanned."""
    parts = df.where(F.col(col).contains("==")).select(*keys, F.posexplode(segment(F.col(col))).alias("part", "text"))
    return parts.where("part % 2 = 0").select(*keys, "part", F.posexplode(highlight_pairs(F.col("text"))).alias("pos", "span"))


def anchor_key(col: Column) -> Column:
    """A heading without white space, case kept."""
    return F.regexp_replace(col, rf"[{BLANK}]+", "")


def humanize_ref(col: Column) -> Column:
    x = F.regexp_replace(strip_quotes(col), r"(?i)\A[a-z][a-z0-9]*:", "")
    return js_trim(F.regexp_replace(F.replace(x, F.lit("--"), F.lit(" ")), "[_-]", " "))


def slugify(col: Column) -> Column:
    x = F.lower(F.regexp_replace(strip_quotes(F.coalesce(col, F.lit(""))), r"(?i)\A[a-z][a-z0-9]*:", ""))
    return F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "-"), r"\A-+|-+\z", "")


def hash6(col: Column) -> Column:
    """FNV-1a over UTF-16 code units, first 6 of 8 hex digits."""
    raw = F.hex(F.encode(col, "UTF-16BE"))
    starts = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw), F.lit(4))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, at: Column) -> Column:
        unit = F.conv(F.substring(raw, at, F.lit(4)), 16, 10).cast("long")
        x = h.bitwiseXOR(unit)
        # times 16777619 modulo 2 ** 32, in parts that stay within 64 bits
        return (x * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295))

    return F.lower(F.substring(F.lpad(F.hex(F.aggregate(starts, F.lit(2166136261).cast("long"), step)), 8, "0"), 1, 6))


def rewrite_page_url(col: Column) -> Column:
    """The first ``/wiki/spaces/`` becomes ``/spaces/``."""
    at = F.locate("/wiki/spaces/", col)
    return F.when(at > 0, F.concat(F.substring(col, F.lit(1), at - 1), F.substring(col, at + 5, F.length(col)))).otherwise(col)


def rewrite_page_urls(col: Column) -> Column:
    """Every ``/wiki/spaces/`` becomes ``/spaces/``."""
    return F.replace(col, F.lit("/wiki/spaces/"), F.lit("/spaces/"))


def to_base64(col: Column) -> Column:
    """Base64 without line breaks of a text's UTF-8."""
    return F.replace(F.base64(F.encode(col, "UTF-8")), F.lit("\r\n"), F.lit(""))


def from_base64(col: Column) -> Column:
    """The text again, null on bad input."""
    return F.decode(F.try_to_binary(col, F.lit("base64")), "UTF-8")


def url_decode(col: Column) -> Column:
    """Percent-decoding; ``+`` stays, bad input is left as it is."""
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)
