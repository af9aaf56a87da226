"""Concatenate-and-cut packing of tokenised texts into fixed windows.

Pass one tokenises every partition where it lies, writing ids and each text's place within its partition. The partitions'
token totals, summed up in order, are their global offsets; with these, pass two cuts each text at the window bounds on its
own. Nothing is shuffled and no task needs another's rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.pieces import by_chars
from faultline.plans.runtime import materialize

#: The cache of a worker starts anew beyond this many entries.
CACHE_PARTS = 700_000
#: Latin characters beyond ASCII whose lower case is one of them too.
LATIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(c.lower()) == 1 and 0xC0 <= ord(c.lower()) < 0x250)
#: Texts of Latin letters, digits, ASCII signs and plain white space without an apostrophe (which may join letters).
PLAIN = re.compile(rf"[\t\n\r !-&(-~{LATIN}]*")
#: In lower case: runs of letters, and runs of signs and digits; no token holds something of both.
PARTS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u024f]+|[^\t\n\r a-z\u00df-\u00f6\u00f8-\u024f]+")


class WordCodec:
    """Ids of whole texts from cached ids of their parts.

    For tokenizers that drop white space, never join across it, fold case and keep letters apart from other signs. Plain
    texts are taken apart into runs of letters and runs of other signs, other texts at spaces, tabs and line ends; the
    library sees each different part once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.parts: dict[str, bytes] = {"": b""}

    @staticmethod
    def _split(text: str) -> list[str]:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return PARTS.findall(text.lower())
        return text.replace("\n", " ").replace("\t", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self._split(t) for t in texts]
        if len(self.parts) > CACHE_PARTS:
            self.parts = {"": b""}
        unseen = list(set().union(*split).difference(self.parts))
        for i in range(0, len(unseen), 10_000):
            some = unseen[i : i + 10_000]
            for part, found in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.parts[part] = np.array(found.ids, self.kind).tobytes()
        get = self.parts.__getitem__
        return [b"".join(map(get, parts)) for parts in split]


@cache
def codec_of(path: str) -> WordCodec:
    """The codec of a worker, kept from task to task."""
    return WordCodec(path)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: ``(part, start, doc_id, doc_tokens, ids, width)`` with ``start`` counted from the partition's first token."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, at, part_no = codec_of(tokenizer_path), 0, TaskContext.get().partitionId()
        end = np.array([end_id], codec.kind).tobytes()
        for batch in batches:
            for part in by_chars(batch, 1, 2_000_000):
                ids = [x + end for x in codec.encode(part.column(1).to_pylist())]
                sizes = np.array([len(x) // codec.kind.itemsize for x in ids], np.int64)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                n = len(ids)
                yield pa.record_batch([pa.array([part_no] * n, pa.int32()), pa.array(starts), part.column(0), pa.array(sizes), pa.array(ids, pa.binary()), pa.array([codec.kind.itemsize] * n, pa.int32())], names=["part", "start", "doc_id", "doc_tokens", "ids", "width"])

    return source.mapInArrow(run, f"part int, start long, doc_id {source.schema['doc_id'].dataType.simpleString()}, doc_tokens long, ids binary, width int")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` to pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset, boundary)``.

    All ids, in the order of partitions and rows, form one stream that is cut every ``window`` ids: sequence ``s`` holds the
    stream's ids from ``s * window`` on, so only the last sequence has padding. A piece is what a text has in one sequence;
    ``start`` counts the text's ids before it, ``ids`` are little-endian unsigned 32-bit, and ``boundary`` marks pieces of a
    text that a window's end cuts. A null or empty text is its end id alone. Texts of any length are cut as often as needed;
    repeated rows are packed each; an empty table gives no piece; other columns are not read. The tokenised rows are written
    to the shared folder once, with their places, so a task that is run again reads the same places.
    """
    spark = docs.sparkSession
    rows = materialize(tokenize(docs, tokenizer_path, end_id, id_col, text_col), "packing")
    # one row a partition: its total, summed up in partition order
    totals = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    before = spark.sparkContext.broadcast(dict(zip((p for p, _ in totals), accumulate([0, *(n for _, n in totals)]), strict=False)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_chars(batch, 4):
                out: list[list] = [[] for _ in range(7)]
                take = []
                for i, (p, start, total, ids, width) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 1, 3, 4, 5)), strict=True)):
                    first = before.value[p] + start
                    wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                    for s in range(first // window, (first + total - 1) // window + 1):
                        a, b = max(first, s * window), min(first + total, (s + 1) * window)
                        take.append(i)
                        for column, value in zip(out, (a - first, b - a, wide[a - first : b - first].tobytes(), total, s, a - s * window, b - a < total), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.record_batch([part.column(2).take(pa.array(take, pa.int32())), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "boundary"])

    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, boundary boolean")
