"""Canonical JSON as one Column expression: sorted keys, no spaces, ASCII only, as ``json.dumps(json.loads(text),
sort_keys=True, separators=(",", ":"))`` writes it, without a Python worker.

The text is parsed and its keys sorted as a variant. Before that, numbers become marked strings, so that no digit is lost
and 1.0 stays apart from 1; after it they are written as the shortest decimal that reads as the same double. Keys are sorted
by code point: a character beyond U+FFFF has U+FFFF before it within the variant, a surrogate without its other half is
spelled after U+D7FF, and these two characters themselves are followed by U+0001.

Null: where the text is null, is no JSON, or has an object with a key twice (such an object has no one form), or is nested
deeper or longer than a variant may be. Integers of any length stay as they are; NaN and Infinity are taken, as Python's reader does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A JSON number, or one of the three names that Python's reader takes as numbers, outside strings.
NUMBER = r"(?<![0-9.eE+-])-?+(?:(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+(?![0-9.eE+-])|Infinity)|NaN"
#: Fewer digits than these tell all doubles apart that are not subnormal, so that they need no search.
SAFE_DIGITS, SAFE_LEAST = 15, 2.2250738585072014e-308
HIGH, LOW = r"\\ud[89ab][0-9a-f]{2}", r"\\ud[c-f][0-9a-f]{2}"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f uses it."""
    return F.transform(F.array(c), f).getItem(0)


def _steps(c: Column, *fs: Callable[[Column], Column]) -> Column:
    for f in fs:
        c = let(c, f)
    return c


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _no_escaped_quotes(c: Column) -> Column:
    """Every quote left is the border of a string."""
    return _replaced(c, ("\\\\", "\\u005c"), ('\\"', "\\u0022"))


def _lower_escapes(c: Column) -> Column:
    def low(part: Column, i: Column) -> Column:
        return F.when(i == 0, part).otherwise(F.concat(F.lower(F.substring(part, 1, 4)), part.substr(F.lit(5), F.length(part))))

    return F.when(F.contains(c, F.lit("\\u")), F.array_join(F.transform(F.split(c, r"\\u", -1), low), "\\u")).otherwise(c)


def _marked(c: Column) -> Column:
    """Characters whose order among UTF-16 units is not that of code points, and halves of surrogate pairs."""
    out = F.regexp_replace(c, r"([\x{D7FF}\x{FFFF}]|\\ud7ff|\\uffff)", r"$1\\u0001")
    out = F.regexp_replace(out, rf"\\u(d[89ab][0-9a-f]{{2}})(?!{LOW})|(?<!{HIGH})\\u(d[c-f][0-9a-f]{{2}})", "\ud7ff\\\\u0002$1$2")
    out = F.regexp_replace(out, rf"([\x{{10000}}-\x{{10FFFF}}]|{HIGH}{LOW})", "\uffff$1")
    return F.when(c.rlike(r"[\x{D7FF}\x{FFFF}\x{10000}-\x{10FFFF}]|\\u(?:d|ffff)"), out).otherwise(c)


def _unmarked(c: Column) -> Column:
    out = F.regexp_replace(c, rf"\\uffff(?={HIGH})", "")
    out = F.regexp_replace(out, r"\\ud7ff\\u0002", r"\\u")
    return F.when(c.rlike(r"\\u(?:d|ffff)"), _replaced(out, ("\\ud7ff\\u0001", "\\ud7ff"), ("\\uffff\\u0001", "\\uffff"))).otherwise(c)


def _ascii(c: Column) -> Column:
    def escaped(run: Column) -> Column:
        return F.when(run.rlike("^[^ -~]"), F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(....)", r"\\u$1")).otherwise(run)

    return F.when(c.rlike("[^ -~]"), F.array_join(F.transform(F.regexp_extract_all(c, F.lit("[ -~]+|[^ -~]+"), F.lit(0)), escaped), "")).otherwise(c)


def _tagged(c: Column) -> Column:
    """Strings get an s before them; numbers become strings with an n."""
    parts = F.split(c, '"', -1)
    body = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit('"s'), p, F.lit('"'))).otherwise(F.regexp_replace(p, NUMBER, '"n$0"'))), "")
    return F.when(F.size(parts) % 2 == 1, F.concat(F.lit('["e",'), body, F.lit(',"e"]')))


def _sorted(c: Column) -> Column:
    """No text has a string e of its own, so one at the third place means that exactly one value was read. A number is no key."""
    v = F.try_parse_json(c)
    return F.when(~c.rlike(r'"n[^"]*+"\s*+:') & (F.try_variant_get(v, "$[2]", "string") == "e"), F.to_json(v))


def _untagged(c: Column) -> Column:
    def one(p: Column, i: Column) -> Column:
        kind, rest = F.substring(p, 1, 1), p.substr(F.lit(2), F.length(p))
        return F.when(i % 2 == 0, p).when(kind == "n", number(rest)).when(kind == "s", F.concat(F.lit('"'), rest, F.lit('"'))).otherwise(F.lit(""))

    return F.array_join(F.transform(F.split(c, '"', -1), one), "")


def _written(sign: Column, digits: Column, point: Column) -> Column:
    """0.digits times 10 ** point, as Python writes a double."""
    n = F.length(digits)
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0")))
        .otherwise(F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, n)))
    )
    e = point - 1
    power = F.concat(F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.abs(e) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(e).cast("string"))
    return F.concat(sign, F.when((point > -4) & (point <= 16), plain).otherwise(F.concat(digits.substr(F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), digits.substr(F.lit(2), n))).otherwise(F.lit("")), power)))


def _decimal(c: Column) -> Column:
    """(sign, digits without zeros at either end, place of the point before them) of a number's text."""
    lead = F.regexp_extract(c, r"^-?([0-9]+)", 1)
    power = F.coalesce(F.regexp_extract(c, r"[eE]\+?(-?[0-9]+)", 1).try_cast("int"), F.lit(0))

    def parts(every: Column, stripped: Column) -> Column:
        point = F.length(lead) + power - (F.length(every) - F.length(stripped))
        return F.struct(F.when(c.startswith("-"), F.lit("-")).otherwise(F.lit("")).alias("sign"), F.rtrim(stripped, F.lit("0")).alias("digits"), point.alias("point"))

    return let(F.concat(lead, F.regexp_extract(c, r"\.([0-9]+)", 1)), lambda e: let(F.ltrim(e, F.lit("0")), lambda s: parts(e, s)))


def _exact(x: Column) -> Column:
    """All digits of a whole double of at most 37 digits, else those that the JVM prints."""
    step = 2**60
    upper = F.floor(x / float(step))
    whole = upper.cast("decimal(19,0)") * F.lit(step).cast("decimal(19,0)") + (x - upper.cast("double") * float(step)).cast("bigint").cast("decimal(19,0)")
    return F.when((x >= 2.0**53) & (x < 1e37), whole.cast("string")).otherwise(x.cast("string"))


def _shortest(d: Column, x: Column) -> Column:
    """The shortest decimal beside d that reads as the double x; of two, the nearer to d."""

    def tried(p: Column) -> Column:
        def same(k: Column) -> Column:
            return F.concat(k.cast("string"), F.lit("e"), (d["point"] - p).cast("string")).try_cast("double") == x

        down = F.rpad(d["digits"], p, "0").cast("long")
        up = (d["digits"].substr(p + 1, F.lit(1)) >= "5").cast("long")
        text = _steps(down, lambda k: F.get(F.filter(F.array(k + up, k + 1 - up), same), F.lit(0)).cast("string"))
        return let(text, lambda s: F.when(s.isNotNull(), F.struct(F.rtrim(s, F.lit("0")).alias("digits"), (d["point"] + F.length(s) - p).alias("point"))))

    usual = F.coalesce(*(tried(F.lit(p)) for p in (15, 16, 17)))
    return F.when(x >= SAFE_LEAST, usual).otherwise(F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(17)), tried), lambda r: r.isNotNull()), F.lit(0)))


def number(c: Column) -> Column:
    """A number's text as Python's reader and writer leave it."""

    def real(d: Column, x: Column) -> Column:
        searched = let(let(_decimal(_exact(x)), lambda j: _shortest(j, x)), lambda s: _written(d["sign"], s["digits"], s["point"]))
        return (
            F.when(x == float("inf"), F.concat(d["sign"], F.lit("Infinity")))
            .when(x == 0, F.concat(d["sign"], F.lit("0.0")))
            .when((F.length(d["digits"]) <= SAFE_DIGITS) & (x >= SAFE_LEAST), _written(d["sign"], d["digits"], d["point"]))
            .otherwise(searched)
        )

    return F.when(c == "-0", F.lit("0")).when(~c.rlike("[.eE]") | c.rlike("[IN]"), c).otherwise(let(_decimal(c), lambda d: let(F.abs(c.try_cast("double")), lambda x: real(d, x))))


def canonical_column(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    text = _steps(c.cast("string"), _no_escaped_quotes, _lower_escapes, _marked, _tagged, _sorted)
    text = _steps(text, _no_escaped_quotes, _lower_escapes, _untagged, _ascii, _unmarked)
    # the marks of both ends are [ , and , ]
    return let(text, lambda t: _replaced(t.substr(F.lit(3), F.length(t) - 4), ("\\u005c", "\\\\"), ("\\u0022", '\\"')))
