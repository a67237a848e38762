"""Text expressions: cleaning, bounds in UTF-8 bytes, strict parsing, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, upper and lower ASCII letters, prefixes,
# the decimal grammar.
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "
DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII alphanumerics and non-ASCII characters."""
    parts = F.split(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " "), UPPER, LOWER), " ")
    return F.filter(parts, lambda x: x != "")


def bigrams(words: Column) -> Column:
    """Neighbouring tokens, joined by 0x1F."""
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit("\x1f"), b))
    )


def clean_line(text: Column) -> Column:
    """NUL and white space runs become one blank; null is empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\x00", " "), SPACE, " "))


def truncate_utf8(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` bytes of whole characters,
    without white space at its end."""
    raw = text.cast("binary")
    cut = None
    for back in range(4):  # a character has at most four bytes
        part = F.try_validate_utf8(F.substring(raw, 1, most - back).cast("string")) if most > back else F.lit("")
        cut = part if cut is None else F.coalesce(cut, part)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(cut, SPACE.rstrip("+") + r"+\z", ""))


def query_text(text: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), clean_line(text))


def identifier(value: Column) -> Column:
    """The value, if it is a non-empty id that a TSV row can hold."""
    return F.when((value != "") & ~value.rlike(r"[\t\n\r]"), value)


def rank_hash(seed: str, value: Column) -> Column:
    """SHA-256 that orders samples; its hex sorts as its bytes do."""
    return F.sha2(F.concat(F.lit(seed), value.cast("string")).cast("binary"), 256)


def parse_decimal(text: Column) -> Column:
    """A finite double of a strict, locale-free literal; null for anything
    else, overflow, and a non-zero literal that becomes zero."""
    value = F.when(text.rlike(DECIMAL), text.try_cast("double"))
    mantissa = F.regexp_replace(text, "[eE].*$", "")
    vanished = (value == 0) & mantissa.rlike("[1-9]")
    return F.when(~vanished & ~F.isnan(value) & (F.abs(value) != float("inf")), value)


def parse_unsigned(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def edit_distance(a: Column, b: Column, limit: int) -> Column:
    """Levenshtein distance; ``limit + 1`` for anything beyond ``limit``."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, F.lit(limit + 1)).otherwise(d)


def nearest_name(word: str, names: list[str], most: int = 2) -> str | None:
    """The name with the least edit distance to a mistyped word, at most
    ``most``; the first in order of names on ties."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    best = min(((distance(word, n), n) for n in names), default=(most + 1, ""))
    return best[1] if best[0] <= most else None


def normalize_url(url: Column) -> Column:
    """Without trailing slashes and one trailing version segment."""
    bare = F.regexp_replace(url, "/+$", "")
    return F.regexp_replace(F.regexp_replace(bare, "/v1$", ""), "/+$", "")


def is_id_list(text: Column) -> Column:
    """Canonical non-negative decimal ids, one blank between them."""
    return text.rlike(r"^(0|[1-9][0-9]*)( (0|[1-9][0-9]*))*$")


def id_list(text: Column) -> Column:
    return F.transform(F.split(text, " "), lambda x: x.cast("long"))
