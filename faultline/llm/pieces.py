"""SentencePiece encoding and decoding that keeps track of where each piece came from.

The text is normalised by longest-prefix lookups in the model's compiled character map, noting for every normalised byte the
source byte it stands for. The pieces tile the normalised text, so their running byte lengths, looked up in that alignment,
give each piece's span in the original UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁".encode()  # stands for a space in pieces
BATCH_CHARS = 4_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 prefixes, and the strings that replace them."""

    def __init__(self, blob: bytes):
        self.units, self.strings = [], b""
        if len(blob) > 4:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest prefix of ``text[at:]`` in the map: how many bytes, and what replaces them."""
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[start : self.strings.index(b"\0", start)])
        return found


class PieceCodec:
    """One model: normaliser with alignment, encoder, decoder."""

    def __init__(self, model_path: str):
        import sentencepiece

        with open(model_path, "rb") as f:
            model = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = next((dict(_fields(v)) for k, v in _fields(model) if k == 3), {})
        self.chars = CharMap(spec.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        n = self.library.get_piece_size()
        self.lengths = np.array([1 if self.library.is_byte(i) else len(self.library.id_to_piece(i).encode()) for i in range(n)], np.int64)
        self.unknown = self.library.unk_id()

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and for the end, the source byte offset."""
        if not raw:
            return b"", np.zeros(1, np.int64)
        mark = MARK if self.escape else b" "
        if not self.chars.units and not self.squeeze:
            # nothing is mapped: spaces widen, all else stays
            widths = np.where(np.frombuffer(raw, np.uint8) == 32, len(mark), 1)
            align = np.repeat(np.arange(len(raw)), widths)
            prefix = mark if self.dummy_prefix else b""
            return prefix + raw.replace(b" ", mark), np.concatenate([np.zeros(len(prefix), np.int64), align, [len(raw)]])
        out, align, at = bytearray(), [], 0
        if self.dummy_prefix:
            out += mark
            align += [0] * len(mark)
        spaced = self.squeeze
        while at < len(raw):
            hit = self.chars.longest(raw, at) if self.chars.units else None
            if hit is None:
                lead = raw[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = (size, raw[at : at + size])
            for i in range(len(hit[1])):
                byte = hit[1][i : i + 1]
                if byte != b" ":
                    spaced = False
                elif self.squeeze and spaced:
                    continue
                else:
                    spaced, byte = self.squeeze, mark
                out += byte
                align += [at] * len(byte)
            at += hit[0]
        if self.squeeze:
            while out.endswith(mark) and len(out) > (len(mark) if self.dummy_prefix else 0):
                del out[-len(mark) :], align[-len(mark) :]
            if bytes(out) == mark and self.dummy_prefix:
                out, align = bytearray(), []
        return bytes(out), np.array([*align, len(raw)], np.int64)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece in the UTF-8 bytes of ``text``; ``ids`` without begin and end ids."""
        raw = text.encode()
        norm, align = self.normalise(raw)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if (ids == self.unknown).any() or (ends[-1] if len(ends) else 0) != len(norm):
            # without byte fallback an unknown piece covers a run of characters; the library says which, and also where
            # pieces and normalised text do not tile
            parts = self.library.encode(text, out_type="immutable_proto").pieces
            cut = np.cumsum([0, *(len(c.encode()) for c in text)])
            return np.array([cut[p.begin] for p in parts], np.int64), np.array([cut[p.end] for p in parts], np.int64)
        return align[ends - lengths], align[ends]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.library.encode(texts, num_threads=1)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.library.decode(x) for x in ids]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` to ``(doc_id, n_tokens, ids, begins, ends, decoded)``, one row per row.

    ``ids`` holds begin id, pieces and end id; ``begins`` and ``ends`` are the pieces' byte spans in the original text (without
    the two added ids); all three are little-endian unsigned 32-bit integers packed as binary. ``decoded`` is what the ids
    decode to. A null text counts as empty: two ids, no span. Texts are encoded whole whatever their length, in Arrow
    batches cut by size, so a task holds a few MB and the longest text. Repeated rows are encoded each; other columns are not
    read; an empty table gives an empty table. The model file must be at the same path on every worker (ship it with the tokenizer package).
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_path)
        bos, eos = codec.library.bos_id(), codec.library.eos_id()
        for batch in batches:
            for part in by_chars(batch, 1):
                texts = part.column(1).to_pylist()
                found = codec.encode(texts)
                full = [np.concatenate([[bos], x, [eos]]).astype("<u4") for x in found]
                spans = [codec.spans(t, x) for t, x in zip(texts, found, strict=True)]
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([len(x) for x in full], pa.int64()),
                        pa.array([x.tobytes() for x in full], pa.binary()),
                        pa.array([b.astype("<u4").tobytes() for b, _ in spans], pa.binary()),
                        pa.array([e.astype("<u4").tobytes() for _, e in spans], pa.binary()),
                        pa.array(codec.decode([x.tolist() for x in full]), pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "begins", "ends", "decoded"],
                )

    return source.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids binary, begins binary, ends binary, decoded string")


def by_chars(batch: pa.RecordBatch, column: int, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of a string column, one row at least."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def map_texts(docs: DataFrame, text_col: str, extra: str, make: Callable[[list[str], dict], list[tuple[str, pa.Array]]]) -> DataFrame:
    """``docs`` with the columns ``extra`` that ``make`` gives for a list of texts (null as empty) and what its task holds."""
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    at = docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for part in by_chars(batch, at):
                made = make([t or "" for t in part.column(at).to_pylist()], held)
                yield pa.record_batch([*part.columns, *(a for _, a in made)], names=[*part.schema.names, *(n for n, _ in made)])

    return source.mapInArrow(run, f"{fields}, {extra}")
