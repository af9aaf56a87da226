"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from labelled texts. A text is compressed in blocks with every
dictionary; the language whose dictionary leaves the fewest bytes wins, and the relative distance to the next one is the
margin. Narrow margins are rejected.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.pieces import map_texts

UNKNOWN = "und"
#: Bytes of text in one compression; each block starts from the dictionary alone, so long texts keep their margin.
BLOCK = 1 << 13
LEVEL = 6
#: Texts up to this size are compressed at a level that finds more of their few matches.
SHORT, SHORT_LEVEL = 1 << 9, 12
LETTER = regex.compile(r"\p{L}")


def lowered(text: str) -> bytes:
    """The whole text in lower case; nothing where it has no letter (marks alone are none)."""
    return text.lower().encode() if LETTER.search(text) else b""


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dict_bytes: int = 1 << 16, sample_docs: int = 512, snippet: int = 512) -> dict[str, bytes]:
    """A dictionary for each non-null language of ``labelled``, the language with most texts first.

    A bounded sample: of each language the ``sample_docs`` different texts with the smallest hashes of id and text, ``snippet``
    characters from a hashed place of each, ``dict_bytes`` bytes in all. However many rows there are and however often they
    repeat, languages x sample_docs x snippet characters reach the driver at most. Rows without text, letters or language teach
    nothing; an empty table gives no dictionary.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("different")).collect()}
    if not counts:
        return {}
    share = F.create_map([x for lang, r in counts.items() for x in (F.lit(lang), F.lit(8.0 * sample_docs / r.different))])
    # the smallest hashes lie below several times their share; that few rows are left to sort
    part_of = F.shiftrightunsigned("h", 1).cast("double") / 2.0**63
    room = F.greatest(F.length("text") - snippet, F.lit(0)) + 1
    some = rows.where(part_of < F.element_at(share, F.col("lang"))).select("lang", "h", F.substring("text", (F.pmod(F.xxhash64("h"), room) + 1).cast("int"), F.lit(snippet)).alias("part")).dropDuplicates(["lang", "h"])
    first = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample_docs)
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for r in first.select("lang", "h", "part").collect():
        by_lang.setdefault(r.lang, []).append((r.h, r.part))
    out = {}
    for lang in sorted(by_lang, key=lambda x: (-counts[x].n, x)):
        content = b"\n".join(filter(None, (lowered(p) for _, p in sorted(by_lang[lang])[:sample_docs])))
        if len(content) >= 8:
            out[lang] = content[:dict_bytes]
    return out


class Classifier:
    """The compressors, one for each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.long = [self._compressor(d, LEVEL) for d in dictionaries.values()]
        self.short = [self._compressor(d, SHORT_LEVEL) for d in dictionaries.values()]

    @staticmethod
    def _compressor(content: bytes, level: int):
        import zstandard as z

        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, data: bytes) -> list[int]:
        if len(data) <= SHORT:
            return [len(c.compress(data)) for c in self.short]
        return [sum(len(c.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)) for c in self.long]

    def __call__(self, text: str | None) -> tuple[str, float, float, int]:
        """Language, score, margin, and the bytes it stands for. The score is the margin on a scale to 1, reached at a third saved."""
        data = lowered(text or "")
        if not data or not self.langs:
            return UNKNOWN, 0.0, 0.0, 0
        order = sorted((size, i) for i, size in enumerate(self.sizes(data)))
        lang = self.langs[order[0][1]]
        if len(order) == 1:
            return lang, 1.0, 1.0, order[0][0]
        margin = 1 - order[0][0] / order[1][0]
        return lang, min(1.0, 3 * margin), margin, order[1][0] - order[0][0]


def label(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = 0.01, min_bytes: int = 5) -> DataFrame:
    """``docs`` with ``lang_pred, score, margin, rejected`` added, one row per row.

    Whole texts are compressed, of any length. Null texts and texts without a letter are ``und`` with score 0, and rejected.
    Ties go to the language with most training texts. ``rejected`` also holds where the best language saves little against the
    second: less than the share ``min_margin``, or less than ``min_bytes`` and, of short texts, four in a hundred bytes (2 bytes at
    least). These are ties, junk, and texts of languages that were not learned. Of held-out texts of 32 bytes or more about 1 in
    200 lie so close; of texts of a word or two, half do.
    Repeated rows are judged each; columns of the added names are replaced, all others pass. Without dictionaries every text
    is ``und``. The dictionaries, whose size ``fit`` bounds, are broadcast. An empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "margin", "rejected")])

    def make(texts: list[str], own: dict) -> list[tuple[str, pa.Array]]:
        if "judge" not in own:
            own["judge"] = Classifier(held.value)
        found = [own["judge"](t) for t in texts]
        narrow = [lang == UNKNOWN or m < min_margin or saved < max(2, min(min_bytes, saved / m / 25)) for lang, _, m, saved in found]
        return [("lang_pred", pa.array([f[0] for f in found], pa.string())), ("score", pa.array([f[1] for f in found], pa.float64())), ("margin", pa.array([f[2] for f in found], pa.float64())), ("rejected", pa.array(narrow, pa.bool_()))]

    return map_texts(docs, text_col, "lang_pred string, score double, margin double, rejected boolean", make)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``(doc_id, lang_pred, score, margin, rejected)`` of ``docs``, from id and text alone; see :func:`label`."""
    return label(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), dictionaries, **settings).drop("text")
