"""Token-id files: documents in ascending order of id, in frames of independently coded blocks.

A file is a Parquet data set (written by Spark's own committer, so a lost task is just run again).
Each row is a frame: the shard (a range of document ids), its number, the ids of the documents in
it, their lengths in tokens, the order-0 model and the coded blocks of ``coder``.  A document never
leaves its frame, so frames can be read alone; ``first`` says how many ids of the shard stand before it.

Defined cases: a null text is empty and has the end id alone; documents with equal ids stand
together, by text; null ids come first; texts of any length are encoded whole; added tokens of the
file (<|endoftext|>) get their own ids, as in the library; ids above ``coder.MOST_ID`` are an error; an
empty table gives an empty file and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodegraph.llm import bpe, coder
from lodegraph.llm.common import sliced_texts, spread, tidy

#: Ids of a frame, about: its blocks are coded in step, so few ids make it slow, and many take memory.
FRAME = 4_000_000


def _visible() -> dict[int, str]:
    """The printable stand-ins of bytes that byte-level vocabularies use: a byte that prints stands
    for itself, the others take the code points from 256 on, in order."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class _Library:
    """The tokenizers library's model in the place of the merge table: ids of distinct pre-tokens."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_buffer(data)  # the model goes with it
        self.model = self.whole.model
        self.shown = np.array([ord(c) for _, c in sorted(_visible().items())], "<u2")

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts, tokenize = [], [], self.model.tokenize
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            line = self.shown[np.frombuffer(b" ".join(some), np.uint8)]
            line[np.cumsum([len(w) + 1 for w in some[:-1]], dtype=np.int64) - 1] = 32  # no byte stands as a space
            for w in line.tobytes().decode("utf-16-le").split(" "):
                got = tokenize(w)
                ids += [t.id for t in got]
                counts.append(len(got))
        return np.array(ids, dtype=np.int64), np.array(counts, dtype=np.int64)


class LibraryEncoder(bpe.Encoder):
    def __init__(self, data: bytes, pattern: str, keep: int = 600_000):
        self.merges, self.cut, self.keep = _Library(data), bpe.PreTokens(pattern), keep
        self.added = [t.content for t in self.merges.whole.get_added_tokens_decoder().values()]
        self.forget()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a text that holds an added token of the file goes through the library as a whole."""
        holds = [any(a in t for a in self.added) for t in texts]
        out = super().encode(["" if h else t for t, h in zip(texts, holds)])
        for i, h in enumerate(holds):
            if h:
                out[i] = np.array(self.merges.whole.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out


_ENCODERS: dict[int, LibraryEncoder] = {}


def _encoder(data: bytes, pattern: str) -> LibraryEncoder:
    key = hash((data, pattern))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(data, pattern)
    return _ENCODERS[key]


def write(docs: DataFrame, path: str, tokenizer: bytes, pattern: str = bpe.PUBLIC_PATTERN, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end``, and write the frames to ``path``."""
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer)  # a few MB at most
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shipped.value, pattern)
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        keys, lens, parts, size, last = [], [], [], 0, np.array([end], np.uint32)

        def frame() -> pa.RecordBatch:
            model, blocks = coder.encode_frame(np.concatenate(parts))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
            row = (shard, number, first, keys, lens, model, blocks)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["shard", "frame", "first", "ids", "lens", "model", "blocks"])

        def gathered():
            """Ids and texts of about 4 MB, out of one batch or several."""
            held_keys, held, n = [], [], 0
            for batch in batches:
                nonlocal id_type
                id_type = batch.column(0).type
                for start, texts in sliced_texts(batch.column(1), 4_000_000):
                    held_keys += batch.column(0).slice(start, len(texts)).to_pylist()
                    held += texts
                    n += sum(map(len, texts))
                    if n >= 3_000_000:
                        yield held_keys, held
                        held_keys, held, n = [], [], 0
            if held:
                yield held_keys, held

        id_type = None
        for some, texts in gathered():
            for key, ids in zip(some, enc.encode(texts)):
                if size >= FRAME:
                    yield frame()
                    number, first = number + 1, first + size
                    keys, lens, parts, size = [], [], [], 0
                keys.append(key)
                lens.append(len(ids) + 1)
                parts += (ids, last)
                size += len(ids) + 1
        if keys:
            yield frame()
        tidy()

    schema = f"shard int, frame bigint, first bigint, ids array<{kind}>, lens array<bigint>, model binary, blocks array<binary>"
    n = spread(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text").mapInArrow(run, schema).write.parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id", id_kind: str = "bigint", with_ids: bool = False) -> DataFrame:
    """id, start, n_tokens, ids_crc32 (and the ids) of every document of the file, from its decoded blocks."""
    schema = f"shard int, frame bigint, first bigint, ids array<{id_kind}>, lens array<bigint>, model binary, blocks array<binary>"
    frames = spark.read.schema(schema).parquet(path)
    # one row per shard: as many as the writer had tasks
    totals = frames.groupBy("shard").agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    ahead = totals.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.column(3).type.value_type
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                flat = coder.decode_frame(row["model"].as_py(), row["blocks"].as_py())
                lens = np.asarray(row["lens"].values, np.int64)
                ends = np.cumsum(lens)
                docs = [flat[e - n : e] for n, e in zip(lens.tolist(), ends.tolist())]
                cols = [
                    pa.array(np.full(len(lens), row["shard"].as_py(), np.int32)), row["ids"].values.cast(id_type), pa.array(row["first"].as_py() + ends - lens),
                    pa.array(lens), pa.array([zlib.crc32(d) for d in docs], pa.int64()),
                    pa.array([d.astype(np.int32) for d in docs] if with_ids else [None] * len(docs), pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "id", "start", "n", "crc", "tokens"])
        tidy()

    out = frames.mapInArrow(run, f"shard int, id {id_kind}, start bigint, n bigint, crc bigint, tokens array<int>")
    cols = [F.col("id").alias(id_col), (F.col("start") + F.col("ahead")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")]
    return out.join(F.broadcast(ahead), "shard").select(*cols, *["tokens"] * with_ids)
