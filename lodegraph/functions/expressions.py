"""Column expressions: identity hashes, tokens, sizes, index and embedding texts, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def symbol_id(file: Column, name: Column, kind: Column) -> Column:
    return F.sha2(F.concat_ws(":", file, name, kind), 256)


def canonical_id(name: Column, kind: Column, body_hash: Column) -> Column:
    """The same for a symbol that moves to another file."""
    return F.sha2(F.concat_ws(":", name, kind, body_hash), 256)


def full_hash(signature: Column, body: Column, doc: Column) -> Column:
    return F.sha2(F.concat(signature, F.lit(":"), body, F.lit(":"), F.coalesce(doc, F.lit(""))), 256)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def index_text(kind: Column, doc: Column, body: Column) -> Column:
    """What full-text search sees: small or constant-like symbols show their bodies too."""
    shown = kind.isin("constant", "variable", "type_alias") | (F.octet_length(body) < 200)
    return F.when(shown, F.concat(F.coalesce(doc, F.lit("")), F.lit(" "), body)).otherwise(F.coalesce(doc, F.lit("")))


def embedding_text(kind: Column, name: Column, chain: Column, signature: Column, doc: Column, callers: Column, deps: Column) -> Column:
    outer = F.slice(chain, F.lit(1), F.greatest(F.size(chain) - 1, F.lit(0)))
    head = F.concat(kind, F.lit(" "), name, F.when(F.size(outer) > 0, F.concat(F.lit(" in "), F.array_join(outer, " > "))).otherwise(F.lit("")))
    listed = lambda label, x: F.when(F.size(x) > 0, F.concat(F.lit(label), F.array_join(x, ", ")))
    return F.concat_ws("\n", head, signature, doc, listed("called by: ", callers), listed("uses: ", deps))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.substring(a, F.lit(1), F.array_max(same))


def lines(text: Column) -> Column:
    """Lines without their ends; a closing line end opens no further line."""
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")


def names_of(csv: Column, keep_blank: bool = False) -> Column:
    """Trimmed parts of a comma-separated list; blanks go unless they are to be kept."""
    parts = F.transform(F.split(csv, ","), lambda x: F.trim(x))
    return parts if keep_blank else F.filter(parts, lambda x: x != "")


def suffix_either_way(a: Column, b: Column) -> Column:
    """Whether one path ends with the other."""
    return a.endswith(b) | b.endswith(a)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def day(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")


def minute(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm")


def shortened(text: Column, most: int) -> Column:
    """At most so many characters, with dots where some are left out."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
