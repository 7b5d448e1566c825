"""Column functions on source text: naming variants, matches with places, comments, literals, SQL names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line: all that Python's splitlines knows.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: White space, as Python's strip knows it.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a name has a seam: separators, and a capital after a small letter or digit.
NAME_SEAM = "[_\\-]+|(?<=[a-z0-9])(?=[A-Z])"
#: The part of a line before a ``//`` outside quotes, as group 1; possessive, so long lines do not recurse.
CODE = r"""(?s)^((?:[^"'\\/]++|\\.|\\$|/(?!/)|"(?:[^"\\]++|\\.)*+(?:"|\\?$)|'(?:[^'\\]++|\\.)*+(?:'|\\?$))*+)"""

# Words with a meaning of their own.
JAVA_KEYWORDS = ["class", "interface", "public", "private", "protected", "return", "new", "null", "true", "false", "void", "object", "string", "long", "int"]
GENERIC_TERMS = ["add", "by", "count", "create", "delete", "exists", "find", "get", "insert", "mapper", "modify", "patch", "query", "read", "remove", "repository", "save", "select", "service", "update"]
PSEUDO_TABLES = ["current_timestamp", "utc_timestamp", "utc_time", "utc_date", "localtimestamp", "localtime", "current_date", "current_time", "now", "sysdate", "dual"]
SQL_NAME = "(?:[A-Za-z_][\\w$]*|`[A-Za-z_][\\w$]*`|\"[A-Za-z_][\\w$]*\"|'[A-Za-z_][\\w$]*')"
#: The last name after a word that comes before tables: what stands before a dot is a schema.
TABLE_NAME = rf"(?iU)\b(?:from|join|into|update|table)\s+(?:{SQL_NAME}\s*\.\s*(?={SQL_NAME}))?({SQL_NAME})"
DDL = r"(?iU)\b(?:create|alter|drop)\s+(?:table|index|database|schema|view)\b"
OP_PREFIXES = [
    ("select", "find|get|read|query|select|count|exists"),
    ("insert", "save|insert|create|add"),
    ("update", "update|modify|patch"),
    ("delete", "delete|remove"),
]
STRING_LITERAL = r'(?s)"((?:\\.|[^"\\])*+)"'


def lines(text: Column) -> Column:
    """The lines of a text; what follows a last line end is no line."""
    return let(F.split(text, LINE_END, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def name_parts(name: Column) -> Column:
    """The words of a name: ``storeNo``, ``store_no`` and ``store-no`` give store, no."""
    parts = F.filter(F.split(name, NAME_SEAM, -1), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(name))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def keyword_variants(keyword: Column, extras: Column | None = None) -> Column:
    """The usual spellings of a keyword and their plurals, with ``extras`` (array), longest first, then by text."""
    parts = name_parts(keyword)
    small = F.transform(parts, F.lower)
    snake, flat, kebab = F.array_join(small, "_"), F.array_join(small, ""), F.array_join(small, "-")
    pascal = F.array_join(F.transform(parts, _capital), "")
    camel = F.concat(small[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _capital), ""))
    names = F.array(keyword, snake, F.upper(snake), flat, kebab, pascal, camel, F.concat(snake, F.lit("s")), F.concat(snake, F.lit("_list")))
    plural = F.when(F.lower(keyword).endswith("s"), F.array().cast("array<string>")).otherwise(F.array(F.concat(camel, F.lit("s")), F.concat(pascal, F.lit("s"))))
    more = F.array().cast("array<string>") if extras is None else F.filter(F.transform(F.coalesce(extras, F.array().cast("array<string>")), strip), lambda x: x != "")
    every = F.array_distinct(F.concat(names, plural, more))
    return F.array_sort(every, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def quote(text: str) -> str:
    """A Java pattern for the text itself."""
    return "".join("\\" + c if not (c.isalnum() or c == "_") and ord(c) < 128 else c for c in text)


def variant_pattern(variants: Sequence[str], compound: bool) -> str:
    """Java pattern of the variants as whole identifiers. Of a keyword of several words, a variant with a first
    capital may also start inside an identifier, after a small letter or digit. No variant: never matches."""
    inner = [v for v in variants if compound and v[:1].isupper()]
    outer = [v for v in variants if v not in inner]
    # variants of the two groups start with different letters, so the order between them does not matter
    groups = [("(?<![A-Za-z0-9$])", outer), ("(?:(?<![A-Za-z0-9$])|(?<=[a-z0-9]))", inner)]
    return "|".join(f"{start}(?:{'|'.join(map(quote, group))})(?![A-Za-z0-9$])" for start, group in groups if group) or "(?!)"


def code_portion(line: Column) -> Column:
    """A line without its comment: nothing of a block comment's line, else up to the first ``//`` outside quotes."""
    return F.when(line.rlike(r"(?U)^\s*(?:/\*|\*)"), "").otherwise(F.regexp_extract(line, CODE, 1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def match_positions(text: Column, pattern: str | Column) -> Column:
    """All matches from left to right: array of (col, from 1, and the matched text)."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def sizes(t: Column) -> Column:
        found = F.regexp_extract_all(t, pattern, F.lit(0))
        return F.struct(found.alias("found"), F.transform(F.split(t, pattern, -1), F.length).alias("gaps"), F.transform(found, F.length).alias("lengths"))

    def places(s: Column) -> Column:
        add = lambda acc, x: acc + x
        before = lambda i: F.aggregate(F.slice(s["gaps"], 1, i + 1), F.lit(0), add) + F.aggregate(F.slice(s["lengths"], 1, i), F.lit(0), add)
        return F.transform(s["found"], lambda m, i: F.struct((before(i) + 1).alias("col"), m.alias("match")))

    return let(let(text, sizes), places)


def occurrence_type(line: Column, col: Column, length: Column) -> Column:
    """annotation, string, definition or identifier, by what stands around the match."""
    before = F.rtrim(F.substr(line, F.lit(1), col - 1), F.lit(BLANKS))
    return (
        F.when(before.endswith("@"), "annotation")
        .when(F.substr(line, col, length + 1).rlike("[\"']"), "string")
        .when(line.contains("(") & F.substr(line, col).contains("(") & before.rlike(r"(?U)\b(public|private|protected|void|int|long|String|var|boolean)\b"), "definition")
        .otherwise("identifier")
    )


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def annotation_names(text: Column) -> Column:
    """Names after ``@``, without their package."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)@(?:[\w.]+\.)?(\w+)"), F.lit(1)))


def terms(text: Column) -> Column:
    """Search terms: identifiers and their camel pieces, lower case, longer than two, without stop words; sorted."""
    names = F.regexp_extract_all(text, F.lit(r"(?U)[A-Za-z_]\w*"), F.lit(0))
    pieces = F.flatten(F.transform(names, lambda n: F.regexp_extract_all(n, F.lit("[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))))
    found = F.filter(F.transform(F.concat(pieces, names), F.lower), lambda t: F.length(t) > 2)
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, JAVA_KEYWORDS + GENERIC_TERMS))))


def slug(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "unknown").otherwise(out)


def unescape_literal(text: Column) -> Column:
    r"""Escapes of a string literal, read from left to right: \n \r \t \' \" \; others stay as written."""
    known = {"\\n": "\n", "\\r": "\r", "\\t": "\t", "\\'": "'", '\\"': '"', "\\\\": "\\"}
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]+|\\$"), F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(table[p], p)), "")


def string_literals(code: Column) -> Column:
    """The unescaped string literals in code, in order."""
    return F.transform(F.regexp_extract_all(code, F.lit(STRING_LITERAL), F.lit(1)), unescape_literal)


def concat_literals(expression: Column) -> Column:
    """``"a" + "b"`` as one text; null if anything but literals, plus signs and blanks is there."""
    raw = F.regexp_extract_all(expression, F.lit(STRING_LITERAL), F.lit(1))
    rest = F.regexp_replace(F.regexp_replace(expression, STRING_LITERAL, ""), r"(?U)[\s+]+", "")
    return F.when((F.size(raw) > 0) & (rest == ""), unescape_literal(F.array_join(raw, "")))


def tables_in_sql(sql: Column) -> Column:
    """Tables that SQL names, in order, distinct, without schema and quotes; pseudo-tables are none."""
    names = F.regexp_extract_all(sql, F.lit(TABLE_NAME), F.lit(1))
    plain = F.transform(names, lambda n: F.btrim(n, F.lit("`\"'")))
    return F.array_distinct(F.filter(plain, lambda n: ~F.lower(n).isin(PSEUDO_TABLES)))


def op_from_sql(sql: Column) -> Column:
    op = F.lower(F.regexp_extract(sql, r"(?iU)^\s*(select|insert|update|delete)\b", 1))
    return F.when(op == "", "unknown").otherwise(op)


def op_from_method(name: Column) -> Column:
    out = F.lit("unknown")
    for op, prefixes in reversed(OP_PREFIXES):
        out = F.when(F.lower(name).rlike(f"^(?:{prefixes})"), op).otherwise(out)
    return out


def is_ddl(sql: Column) -> Column:
    return sql.rlike(DDL)


def simple_name(type_name: Column) -> Column:
    """A type without package and generics."""
    last = F.element_at(F.split(type_name, r"\."), -1)
    return strip(F.split(last, "<")[0])


def class_of(qual: Column) -> Column:
    """What stands before the last dot; the whole without one."""
    return F.when(qual.contains("."), F.regexp_extract(qual, r"(?s)^(.*)\.", 1)).otherwise(qual)
