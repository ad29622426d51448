"""Column functions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridledger import fixed_values as fv

# Unicode white space, as a character class and as trim characters.
SPACE_CLASS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
SPACE_CHARS = "".join(
    chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
# A single plain blank stays as it is, so that it is no match to replace.
SPACE_RUN = SPACE_CLASS + "{2,}|" + SPACE_CLASS.replace("\\x20", "\\x1f")
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hash_key(*cols: Column | str) -> Column:
    """SHA-256 of the pipe-joined parts; null parts are left out."""
    return F.sha2(F.concat_ws("|", *[col_of(c).cast("string") for c in cols]), 256)


def time_text(ts: Column | str) -> Column:
    return F.date_format(col_of(ts), fv.TELEMETRY_TIME_FORMAT)


def parse_time(text: Column | str, fmt: str = fv.TELEMETRY_TIME_FORMAT) -> Column:
    """Text to timestamp; malformed text gives null, also in ANSI mode."""
    return F.try_to_timestamp(col_of(text), F.lit(fmt))


def hour_of(ts: Column | str) -> Column:
    return F.date_trunc("hour", col_of(ts))


def kw_to_mwh(kw: Column, sample_seconds: float) -> Column:
    """Energy of summed kW samples that each stand for ``sample_seconds``."""
    return kw * F.lit(float(sample_seconds)) / 3600.0 / 1000.0


def positive(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def is_curtailed(status: Column | str) -> Column:
    """Prefix, one more character, anything: the LIKE form with its wildcard."""
    return col_of(status).like(fv.CURTAILED_PREFIX + "_%")


def squash(text: Column | str) -> Column:
    """Collapse white space runs to single blanks and trim."""
    return F.trim(F.regexp_replace(col_of(text), SPACE_RUN, " "))


def strip(text: Column | str) -> Column:
    return F.btrim(col_of(text), F.lit(SPACE_CHARS))


def heading_of(line: Column, clean: Column) -> Column:
    """The heading a trimmed line declares, or null; ``clean`` is its squashed form.

    A line that differs from its squashed form never opens a section.
    """
    numbered = clean.rlike("(?iU)" + fv.HEADING_PATTERN)
    caps = (
        (F.length(clean) <= fv.CAPS_HEADING_MAX_CHARS)
        & (F.upper(clean) == clean)
        & clean.rlike("\\p{L}")
    )
    heading = F.substring(clean, 1, fv.HEADING_MAX_CHARS)
    same = F.substring(line, 1, fv.HEADING_MAX_CHARS) == heading
    return F.when(same & (caps | numbered), heading)


def heading_candidate(line: Column) -> Column:
    return let(squash(line), lambda clean: heading_of(line, clean))


def clause_type(text: Column | str) -> Column:
    """The clause class with the most keyword hits; ties go to the first class."""
    lowered = F.lower(col_of(text))

    def ranked(low: Column) -> Column:
        # The closing entry wins only when every class scores zero.
        entries = [F.struct(F.lit(0).alias("hits"), F.lit(1).alias("order"), F.lit(None).cast("string").alias("name"))]
        for position, (name, words) in enumerate(fv.CLAUSE_KEYWORDS.items()):
            hits = sum((F.contains(low, F.lit(word)).cast("int") for word in words), F.lit(0))
            entries.append(F.struct(hits.alias("hits"), F.lit(-position).alias("order"), F.lit(name).alias("name")))
        return F.array_max(F.array(*entries))["name"]

    return let(lowered, ranked)


def rough_tokens(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col_of(text)) / 4).cast("int"))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; null when either has zero length."""
    zero = F.lit(0.0)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda acc, v: acc + v
        )

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def priority(value: Column | str) -> Column:
    value = col_of(value)
    return F.when(value.isin(*fv.PRIORITIES), value).otherwise(F.lit(fv.DEFAULT_PRIORITY))


def float_text(value: Column | str) -> Column:
    """Shortest decimal text of a double, without exponent up to 1e16."""
    value = col_of(value)
    plain = value.cast("string")
    wide = F.regexp_replace(plain.try_cast("decimal(38,18)").cast("string"), "0+$", "")
    wide = F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide)
    return F.when(plain.contains("E") & (F.abs(value) < 1e16) & (F.abs(value) >= 1e-4), wide).otherwise(plain)


def fact_text(value: Column | str, kind: str = "string") -> Column:
    """Text of a fact as shown to people: null is None, booleans are capitalised."""
    value = col_of(value)
    if kind == "boolean":
        shown = F.when(value, "True").when(~value, "False")
    elif kind == "double":
        shown = float_text(value)
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit("None"))


def mime_type(path: Column | str) -> Column:
    """MIME type from the file suffix."""
    name = F.lower(col_of(path))
    return (
        F.when(name.endswith(".txt"), "text/plain")
        .when(name.endswith(".md"), "text/markdown")
        .when(name.endswith(".pdf"), "application/pdf")
        .when(name.endswith(".html") | name.endswith(".htm"), "text/html")
        .otherwise("application/octet-stream")
    )


def non_null(items: Iterable[Column]) -> Column:
    """Array of the given values without the nulls."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Concatenate a text template and columns; one pass, no regex."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(values[name])
    return F.concat(*parts)


def list_text(items: Column) -> Column:
    """Bracketed, comma-separated text of an array of numbers."""
    return F.concat(F.lit("["), F.array_join(items.cast("array<string>"), ", "), F.lit("]"))


def json_text(value: Column) -> Column:
    """A JSON string literal, or null. Control characters are escaped, other characters stay as they are."""
    listed = F.to_json(F.array(value.cast("string")))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def days_between(end: Column | str, start: Column | str) -> Column:
    return F.datediff(col_of(end), col_of(start))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.unix_timestamp(col_of(end)) - F.unix_timestamp(col_of(start))


def share(part: Column, whole: Column) -> Column:
    """Ratio that is null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


_BLOCK_CHARS = 32768


def text_blocks(text: Column, reach: int) -> Column:
    """The text as blocks that overlap by ``reach`` characters.

    Finding a character position walks the text from its start; reading many
    pieces of a long text from blocks keeps that walk short.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(_BLOCK_CHARS))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(_BLOCK_CHARS + reach)))


def read_piece(blocks: Column, at: Column, length: Column) -> Column:
    """Up to ``reach`` characters from zero-based position ``at``."""
    block = F.get(blocks, F.floor(at / _BLOCK_CHARS).cast("int"))
    return F.substring(block, at % _BLOCK_CHARS + 1, length)
