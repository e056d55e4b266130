"""Information-theoretic sanitisation of personal data.

First the base spans: e-mail addresses, IP addresses, card numbers that pass Luhn's check and
phone numbers.  Their values are the protected entities.  Then the corpus says how strongly the
terms beside an entity reveal it: with n documents, n_e that hold the entity, n_t the term and
n_et the term beside the entity, the information content of the entity is -log2(n_e / n) and the
pointwise mutual information log2(n n_et / (n_e n_t)).  A term whose share of the content exceeds
``generalise`` is generalised at every place in each document that holds that entity, and removed above
``remove``.  A term counts only if chance would bring it into the entity's documents as often with a probability of at most
``chance``, by the bound exp(-n_e KL(n_et / n_e || n_t / n)) on the hypergeometric tail: n_t / n for an
entity of one document, so rare entities are judged like the others, and only very small tables can't tell.

Counts cover all documents: one scan yields spans, the terms of documents with entities, and each task's
document counts by term; the counts meet in grouped sums.  No text is shuffled.

Defined cases: null texts are empty and have no spans; texts of any length are searched whole;
repeated rows each get their spans and count each as a document; matches that fail their check are
dropped without another try; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import free_name, settle, sliced_texts, tidy

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits matches from its start or not at all, so no match starts inside one
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
#: Terms: runs of ASCII letters and of all that is not ASCII, in lower case.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_TERM = re.compile(r"[A-Za-z\u0080-\U0010ffff]+")


@dataclass(frozen=True)
class Params:
    """Shares of an entity's information content; chance: significance; shortest: code points of a term."""

    generalise: float = 0.8
    remove: float = 0.95
    chance: float = 0.05
    shortest: int = 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches: one can only start where the run before an @ starts."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            end = max(end, at)  # no later match starts before this @
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    raw = text.encode("utf-8", "surrogatepass")
    out = [("email", s, e) for s, e in _emails(text)] if b"@" in raw else []
    digits = len(raw.translate(None, _NOT_DIGIT))
    if digits >= 4 and raw.count(b".") >= 3:
        for m in _IP.finditer(text):
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
    if digits >= 16:
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if digits >= 8 and b"+" in raw:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _key(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def entities_of(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """Keys of the protected entities of a text, each once."""
    out = set()
    for kind, s, e in spans:
        value = text[s:e].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[s:e])
        out.add(_key(f"{kind}:{value}".encode("utf-8", "surrogatepass")))
    return sorted(out)


def places(text: str, spans: list[tuple[str, int, int]], p: Params) -> dict[bytes, tuple[int, list[int]]]:
    """Length and starts of every term of a text; a place that touches a base span is left out, its term is not."""
    covered: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    out: dict[bytes, tuple[int, list[int]]] = {}
    k = 0
    for m in _TERM.finditer(text):
        a, b = m.span()
        if b - a < p.shortest:
            continue
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        _, at = out.setdefault(m[0].encode("utf-8", "surrogatepass").translate(_FOLD), (b - a, []))
        if k == len(covered) or b <= covered[k][0]:
            at.append(a)
    return out


class _Near:
    """The terms of documents with their places, as flat columns of an Arrow list."""

    def __init__(self):
        self.docs, self.starts = array("i", [0]), array("i", [0])
        self.t, self.n, self.at = array("q"), array("i"), array("i")

    def add(self, terms: list[tuple[int, int, list[int]]]) -> None:
        for t, n, at in terms:
            self.t.append(t)
            self.n.append(n)
            self.at.extend(at)
            self.starts.append(len(self.at))
        self.docs.append(len(self.t))

    def column(self) -> pa.Array:
        at = pa.ListArray.from_arrays(pa.array(self.starts, pa.int32()), pa.array(self.at, pa.int32()))
        x = pa.StructArray.from_arrays([pa.array(self.t, pa.int64()), pa.array(self.n, pa.int32()), at], names=["t", "n", "at"])
        return pa.ListArray.from_arrays(pa.array(self.docs, pa.int32()), x)


def twin_of(text_col: str) -> Column:
    """A hash of the text, which names a row together with its id."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def scan(docs: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (spans, entities and, where there are any, all terms) and, with a null twin, rows of
    a task's document counts by term.  ``row`` names a document also where ids repeat."""
    kind = docs.schema[id_col].dataType.simpleString()
    counts_t = pa.list_(pa.struct([("t", pa.int64()), ("df", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        counts: dict[int, int] = {}
        row = TaskContext.get().partitionId() << 40

        def key(w: bytes) -> int:
            k = cache.get(w)
            if k is None:
                if len(cache) > 100_000:
                    cache.clear()
                k = cache[w] = _key(w)
            return k

        def batch_of(ids, rows, twins, kinds, base, ents, near, cs):
            cols = [ids, pa.array(rows, pa.int64()), twins]
            cols += [pa.array([k[i] for k in kinds], pa.int64()) for i in range(4)]
            cols += [pa.array(base, pa.string()), pa.array(ents, pa.list_(pa.int64())), near.column(), pa.array(cs, counts_t)]
            return pa.RecordBatch.from_arrays(cols, names=["id", "row", "twin", *(f"n_{k}" for k in KINDS), "base", "entities", "near", "counts"])

        def tell():
            items = list(counts.items())
            counts.clear()
            for i in range(0, len(items), 4096):
                part = [{"t": t, "df": n} for t, n in items[i : i + 4096]]
                none = _Near()
                none.add([])
                yield batch_of(pa.nulls(1, id_type), [None], pa.nulls(1, pa.int64()), [[None] * 4], [None], [None], none, [part])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for start, texts in sliced_texts(batch.column(1), 4_000_000):
                kinds, base, ents, near = [], [], [], _Near()
                for text in texts:
                    spans = base_spans(text)
                    raw = text.encode("utf-8", "surrogatepass")
                    for w in set(raw.translate(_FOLD).split()):
                        if len(w) >= p.shortest:
                            k = key(w)
                            counts[k] = counts.get(k, 0) + 1
                    kinds.append([sum(k == s[0] for s in spans) for k in KINDS])
                    base.append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
                    ents.append(entities_of(text, spans) if spans else [])
                    near.add([(key(w), n, at) for w, (n, at) in places(text, spans, p).items()] if spans else [])
                    if len(counts) > 250_000:
                        yield from tell()
                n = len(texts)
                yield batch_of(batch.column(0).slice(start, n), range(row, row + n), batch.column(2).slice(start, n), kinds, base, ents, near, [None] * n)
                row += n
        if counts:
            yield from tell()
        cache.clear()
        tidy()

    schema = (
        f"id {kind}, row bigint, twin bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS)
        + ", base string, entities array<bigint>, near array<struct<t:bigint,n:int,at:array<int>>>, counts array<struct<t:bigint,df:bigint>>"
    )
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), twin_of(text_col)).mapInArrow(run, schema)


def disclosing(scanned: DataFrame, p: Params) -> DataFrame:
    """row, t, share: the terms of each document and the largest share of an entity's content that they give away.

    n_et never exceeds n_e, so only terms with n_t <= n (n_e / n)^generalise can reach the share: they
    alone meet the entities.  Entities of the very same documents are disclosed alike and go as one class.
    """
    docs = scanned.where("twin is not null")
    n = float(docs.count())
    ents = docs.select("row", F.explode("entities").alias("e"))
    n_e = ents.groupBy("e").agg(F.count("*").alias("n_e"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("mark"))
    # an entity that stands in every document has no content to give away
    classes = ents.join(n_e, "e").where(F.col("n_e") < n).select("row", "n_e", "mark").distinct()
    classes = settle(classes, "classes")
    terms = docs.where(F.size("near") > 0).select("row", F.explode("near.t").alias("t"))
    counts = scanned.where("counts is not null").select(F.explode("counts").alias("c")).select("c.t", "c.df")
    n_t = counts.join(terms.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.sum("df").alias("n_t"))
    most = classes.agg(F.max("n_e")).first()[0] or 0
    within = lambda held: F.log2(n / F.col("n_t")) >= p.generalise * F.log2(n / held) - 1e-9
    n_t = n_t.where(within(F.lit(float(most or 1))))
    pairs = terms.join(n_t, "t").join(classes, "row").where(within(F.col("n_e")))
    pairs = settle(pairs.select("row", "n_e", "mark", "t", "n_t"), "pairs")
    told = pairs.groupBy("n_e", "mark", "t", "n_t").agg(F.count("*").alias("n_et"))
    mutual = F.log2(n * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    # the logarithm of the bound on the tail, with its sign turned
    apart = F.col("n_e") - F.col("n_et")
    without = F.when(apart > 0, apart * F.log(apart / F.col("n_e") / (1 - F.col("n_t") / n))).otherwise(0.0)
    rare = F.col("n_et") * mutual * math.log(2) + without >= -math.log(p.chance)
    told = told.where(rare).withColumn("share", mutual / F.log2(n / F.col("n_e"))).where(F.col("share") >= p.generalise)
    return pairs.join(told.select("n_e", "mark", "t", "share"), ["n_e", "mark", "t"]).groupBy("row", "t").agg(F.max("share").alias("share"))


def find(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, twin, n_email, n_ip, n_card, n_phone, base, spans, removed of every row."""
    scanned = settle(scan(docs, p, id_col, text_col), "spans")
    rows = scanned.where("twin is not null")
    told = disclosing(scanned, p)
    where = rows.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.t", "x.n", "x.at")
    spots = F.transform("at", lambda s: F.struct(s.alias("s"), (s + F.col("n")).alias("n"), F.col("share").alias("share")))
    hits = where.join(told, ["row", "t"]).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list(spots))).alias("hits"))
    out = rows.select("id", "row", "twin", *[f"n_{k}" for k in KINDS], "base").join(hits, "row", "left")
    name = lambda x: F.concat(F.lit("term:"), x["s"].cast("string"), F.lit(":"), x["n"].cast("string"))
    terms = F.array_join(F.transform("hits", name), ",")
    gone = F.array_join(F.transform(F.filter("hits", lambda x: x["share"] >= p.remove), name), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("hits") > 0, terms))
    return out.select(F.col("id").alias(id_col), "twin", *[f"n_{k}" for k in KINDS], "base", spans.alias("spans"), F.coalesce(gone, F.lit("")).alias("removed"))


def sanitised(text: str, spans: str, removed: str = "") -> str:
    """The text with its spans replaced by their kind; removed terms leave nothing; overlapping spans go together."""
    gone = set(removed.split(",")) if removed else set()
    found = sorted((int(s), -int(e), k, f"{k}:{s}:{e}" in gone) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for s, e, kind, drop in found:
        if s >= at:
            out.append(text[at:s])
            out.append("" if drop else f"[{kind.upper()}]")
        at = max(at, -e)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with sanitised texts (null texts stay null); all other columns as they were."""
    id_, twin_, spans_, removed_ = (free_name(docs, x) for x in ("id", "twin", "spans", "removed"))
    spans = find(docs, p, id_col, text_col).where("spans <> ''").select(F.col(id_col).alias(id_), F.col("twin").alias(twin_), F.col("spans").alias(spans_), F.col("removed").alias(removed_))
    spans = settle(spans.dropDuplicates([id_, twin_]), "found")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_cols.index(text_col)
        for batch in batches:
            for start, texts in sliced_texts(batch.column(at)):
                b = batch.slice(start, len(texts))
                found = b.column(len(docs_cols)).to_pylist(), b.column(len(docs_cols) + 1).to_pylist()
                new = pa.array([sanitised(t, s, r or "") if t and s else t for t, s, r in zip(texts, *found)], b.column(at).type)
                new = pc.if_else(pc.is_null(b.column(at)), b.column(at), new)
                yield pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(len(docs_cols))], names=docs_cols)
        tidy()

    docs_cols = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    joined = docs.join(spans, F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (twin_of(text_col) == F.col(twin_)), "left")
    joined = joined.select(*[f"`{c}`" for c in docs_cols], spans_, removed_)
    return joined.mapInArrow(replace, fields)
