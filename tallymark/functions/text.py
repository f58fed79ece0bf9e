"""Strings, numbers and identifiers, with Python's Unicode rules where Java's differ.

All functions take and give Columns and are null for null unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods see it.
WS = r"[\s\x1c-\x1f]"
ARABIC_DIGITS, DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return strip(F.regexp_replace(c, f"(?U){WS}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def content_hash(text: Column, source_path: Column | None = None) -> Column:
    """Equal for texts that differ in case and white space only; the path sets copies apart."""
    path = F.lit("") if source_path is None else F.coalesce(source_path, F.lit(""))
    return F.sha2(F.concat(collapse(F.lower(F.coalesce(text, F.lit("")))), F.lit("\0"), path), 256)


def identifier(c: Column) -> Column:
    """Without white space, hyphens, slashes and dots, in upper case; null if nothing is left."""
    # most hold signs of ASCII only and no white space
    return blank_to_null(F.upper(F.when(c.rlike(r"^[!-~]*\z"), F.translate(c, "-/.", "")).otherwise(F.regexp_replace(c, f"(?U)(?:{WS}|[-/.])", ""))))


#: Numbers as most documents write them, and what goes before they are read: the first that fits.
COMMON = ((r"^[0-9]{1,15}(?:[.][0-9]{1,2})?$", ""), (r"^[0-9]{1,3}(?:[, ][0-9]{3}){1,4}(?:[.][0-9]{1,2})?$", ", "), (r"^[0-9]{1,15} [A-Za-z/]+$", "unit"), (r"^[0-9]{1,3}(?:[.][0-9]{3}){0,4},[0-9]{1,2}$", "."))


def number(raw: Column) -> Column:
    """A number as documents write it: currency signs and codes, units, and either kind of separators.

    Dots in groups of three are thousands, so 1.234 is 1234; a comma before one or two last
    digits is decimal. Null if no plain number is left.
    """
    from tallymark.tables import let

    def either(v: Column) -> Column:
        out = _any_number(v)
        for pattern, drop in reversed(COMMON):
            plain = F.substring_index(v, " ", 1) if drop == "unit" else F.translate(v, ",.", ".") if drop == "." else F.translate(v, drop, "") if drop else v
            out = F.when(v.rlike(pattern), plain.cast("double")).otherwise(out)
        return out

    return let(raw, either)


def _any_number(raw: Column) -> Column:
    s = F.translate(strip(raw), ARABIC_DIGITS, DIGITS)
    s = strip(F.regexp_replace(F.regexp_replace(s, "[€$£¥]", ""), rf"(?iU)^[a-z]{{3}}{WS}*", ""))
    s = F.replace(strip(F.regexp_replace(s, rf"(?U){WS}+[A-Za-z/]+$", "")), F.lit(" "), F.lit(""))

    def settled(s: Column) -> Column:
        no_commas = F.replace(s, F.lit(","), F.lit(""))
        decimal_comma = F.replace(s, F.lit(","), F.lit("."))
        commas = F.length(s) - F.length(no_commas)
        after = F.length(F.substring_index(s, ",", -1))
        plain = (
            F.when(s.rlike(r"^[\d.]+,\d{1,2}$"), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(s.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(s, F.lit("."), F.lit("")))
            .when((commas == 1) & (after <= 2), decimal_comma)
            .otherwise(no_commas)
        )
        return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))

    from tallymark.tables import let

    return let(s, settled)


def integer(raw: Column) -> Column:
    """``number``, cut toward zero."""
    return number(raw).try_cast("bigint")


def container(c: Column) -> Column:
    """A container number without the size that may follow it, as in 40'HC."""
    return blank_to_null(strip(F.regexp_replace(c, rf"(?U){WS}+\d{{2}}'[A-Z]{{2}}{WS}*$", "")))


def party(c: Column) -> Column:
    """The first line of an address, without punctuation at its end."""
    return blank_to_null(F.regexp_replace(strip(F.get(F.split(c, "\n"), F.lit(0))), rf"(?U)(?:{WS}|[,.])+$", ""))


def comparable(c: Column) -> Column:
    """What names are compared by: lower case, single spaces."""
    return collapse(F.lower(c))


def despaced(c: Column) -> Column:
    """Titles set as single capitals, P A C K I N G, closed up; then runs of white space to one."""
    closed = F.regexp_replace(c, r"(?U)(?<=\b[A-Z]) (?=[A-Z]\b)", "")
    return F.regexp_replace(closed, rf"(?U){WS}{{2,}}", " ")


def rounded(c: Column, digits: int) -> Column:
    """A double to so many digits after the point (0 to 15): the nearest to its binary value, ties to even, as Python rounds.

    The double is multiplied by a power of ten in two parts, product and error, which together are exact: both factors are
    cut into halves whose products fit a double. What is left over half of a unit then has the right sign. Doubles too large for
    that (2^52 and more after scaling) are rounded by their fraction alone.
    """
    from tallymark.tables import let

    scale = float(10**digits)
    cut = 134217729.0  # 2^27 + 1
    lit_high = scale * cut - (scale * cut - scale)
    lit_low = scale - lit_high

    def unit(x: Column) -> Column:
        """x times the power of ten as the nearest integer; x is not negative and small enough."""

        def exact(p: Column) -> Column:
            return let(x * cut - (x * cut - x), lambda high: let(((high * lit_high - p) + high * lit_low + (x - high) * lit_high) + (x - high) * lit_low, lambda error: nearest(p, error)))

        def nearest(p: Column, error: Column) -> Column:
            return let(F.floor(p).cast("double"), lambda k: let((p - k - 0.5) + error, lambda over: k + F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(F.pmod(k, F.lit(2.0)))))

        return let(x * scale, exact)

    def whole(x: Column) -> Column:
        large = let(F.floor(x).cast("double"), lambda k: k + unit(x - k) / scale)
        return F.when(x >= 2.0**52, x).when(x * scale >= 2.0**52, large).otherwise(unit(x) / scale)

    sized = let(c.cast("double"), lambda v: F.when(F.isnan(v), v).when(v < 0, -let(-v, whole)).otherwise(let(v, whole)))
    return F.when(c.isNotNull(), sized)


def shown_double(c: Column) -> Column:
    """A double as Python shows it: plain between 1e-4 and 1e16, always with a fraction."""
    text = c.cast("string")
    plain = F.regexp_replace(F.format_string("%.17f", c), r"0+$", "")
    big = F.concat(c.try_cast("decimal(38,0)").cast("string"), F.lit(".0"))
    exact = F.regexp_replace(c.try_cast("decimal(38,15)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), F.when(c == F.floor(c), big).otherwise(exact)).when((F.abs(c) < 1e-3) & (F.abs(c) >= 1e-4), F.regexp_replace(plain, r"\.$", ".0")).otherwise(text)


def shown_type(c: Column) -> Column:
    """A document type in prose."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def group_name(rank: Column) -> Column:
    return F.format_string("G%02d", rank)


def shipment_prefix(path: Column) -> Column:
    """S01 of a file name that starts with it."""
    return blank_to_null(F.upper(F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?i)^(S\d+)", 1)))


def secret(c: Column) -> Column:
    """The first eight and last four signs of a secret that is longer than both."""
    return F.when(F.length(c) > 12, F.concat(F.substring(c, 1, 8), F.lit("..."), F.right(c, F.lit(4)))).otherwise(F.when(c != "", F.lit("***")).otherwise(c))


def indel_ratio(a: Column, b: Column) -> Column:
    """2 x the longest common subsequence / both lengths, between 0 and 1; 1 for two empty strings.

    Dynamic programming over nested arrays: one row of lengths for each sign of ``a``.
    """
    from tallymark.tables import let

    def ratio(a: Column, b: Column) -> Column:
        zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

        def next_row(row: Column, i: Column) -> Column:
            sign = F.substring(a, i, F.lit(1))

            def step(acc: Column, j: Column) -> Column:
                hit = sign == F.substring(b, j, F.lit(1))
                best = F.when(hit, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.get(acc, j - 1)))
                return F.concat(acc, F.array(best))

            return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), step)

        rows = F.aggregate(F.sequence(F.lit(1), F.length(a)), zero, next_row)
        total = F.length(a) + F.length(b)
        return F.when(total == 0, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(2.0 * F.get(rows, F.length(b)) / total)

    return F.when(a.isNotNull() & b.isNotNull(), let(a, lambda x: let(b, lambda y: ratio(x, y))))
