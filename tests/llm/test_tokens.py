"""SentencePiece and packing against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import packing, pieces
from faultline.llm.queries import model_path, op2_sentencepiece, op8_packing

TEXTS = ["", None, "Hello  world\n\tthis is 日本 a  test <s> ▁x", " lead", "x" * 5000, "é" * 3 + " fin.", "á b c it's 12 <|startoftext|>don't", "\x00", "same", "same", " ".join(["word"] * 5000)]
SCHEMA = "doc_id long, text string, ids string, start int, part string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


def test_pieces_match_the_library_and_spans_tile_the_text(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in pieces.encode(docs, model_path("piece_bpe_32k.model")).collect()}
    assert sorted(rows) == list(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        ids = np.frombuffer(rows[i].ids, "<u4").tolist()
        assert ids == sp.encode(text or "", add_bos=True, add_eos=True)
        assert rows[i].decoded == sp.decode(ids) and rows[i].n_tokens == len(ids)
        begins, ends, raw = np.frombuffer(rows[i].begins, "<u4").tolist(), np.frombuffer(rows[i].ends, "<u4").tolist(), (text or "").encode()
        assert len(begins) == len(ids) - 2
        if raw:
            assert begins[0] == 0 and ends[-1] == len(raw) and begins[1:] == ends[:-1]
        for a, b, k in zip(begins, ends, ids[1:-1], strict=True):
            if not sp.is_byte(k) and a > 0:
                assert raw[a:b].decode() == sp.id_to_piece(k).replace("▁", " " if b" " in raw[a:b] else "▁")


def test_character_map_takes_the_longest_prefix_and_aligns():
    # a double array for the keys "a" -> "X", "ab" -> "YZ", laid out by hand
    units = [0] * 1024
    offset = lambda n: n << 10
    units[0] = offset(256)
    units[256 ^ 97] = 97 | 1 << 8 | offset((256 ^ 97) ^ 512)  # children of "a" lie at 512
    units[512] = 0 | 1 << 31
    units[512 ^ 98] = 98 | 1 << 8 | offset((512 ^ 98) ^ 400)
    units[400] = 2 | 1 << 31
    blob = np.array(units, "<u4").tobytes()
    chars = pieces.CharMap(len(blob).to_bytes(4, "little") + blob + b"X\0YZ\0")
    assert chars.longest(b"abc", 0) == (2, b"YZ") and chars.longest(b"ac", 0) == (1, b"X") and chars.longest(b"c", 0) is None
    codec = object.__new__(pieces.PieceCodec)
    codec.chars, codec.dummy_prefix, codec.squeeze, codec.escape = chars, True, True, True
    norm, align = codec.normalise(b"  ab  a c ")
    assert norm.decode() == "▁YZ▁X▁c"
    assert align.tolist() == [0, 0, 0, 2, 2, 4, 4, 4, 6, 7, 7, 7, 8, 10]


def test_word_cache_takes_every_character_of_its_fast_class():
    codec = packing.WordCodec(model_path("word_bpe_49k.json"))
    for c in map(chr, (*range(9, 14), *range(32, 127), *range(0xA0, 0x250))):
        text = f"A{c}b {c} {c}{c} 1{c}x {c}"
        assert np.frombuffer(codec.encode([text])[0], codec.kind).tolist() == codec.library.encode(text, add_special_tokens=False).ids, hex(ord(c))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet=[chr(c) for c in (*range(9, 14), *range(32, 127), *range(0xA0, 0x250), 0x301, 0x307)])))
def test_word_cache_equals_the_tokenizer(text):
    global CODEC
    CODEC = globals().get("CODEC") or packing.WordCodec(model_path("word_bpe_49k.json"))
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(CODEC.encode([text])[0], CODEC.kind).tolist() == CODEC.library.encode(text, add_special_tokens=False).ids


def test_packing_is_gapless_and_holds_every_id_once(docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(model_path("word_bpe_49k.json"))
    rows = packing.pack(docs, model_path("word_bpe_49k.json"), window=64).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, parts in by_seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == max(by_seq)
    for i, text in enumerate(TEXTS):
        parts = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist()
        assert ids == [*tk.encode(text or "", add_special_tokens=False).ids, 1]
        assert all(p.doc_tokens == len(ids) and p.boundary == (len(parts) > 1) for p in parts)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert pieces.encode(none, model_path("piece_bpe_32k.model")).count() == 0
    assert packing.pack(none, model_path("word_bpe_49k.json")).count() == 0


def test_queries_match_brute_force(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    at = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path("piece_bpe_32k.model"))
    got = op2_sentencepiece(spark, at).collect()
    assert len(got) == len(text)
    for r in got:
        ids = sp.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    tk = Tokenizer.from_file(model_path("word_bpe_49k.json"))
    total = 0
    for r in op8_packing(spark, at).collect():
        ids = np.array([*tk.encode(text[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        total += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    assert total == sum(len(tk.encode(t, add_special_tokens=False).ids) + 1 for t in text.values())
