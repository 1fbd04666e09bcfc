"""Encoders against the public libraries, and packing."""

from __future__ import annotations

import hashlib
import json
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from conftest import DATA
from hypothesis import given, settings, strategies as st

from quillstack.llm import packing, pieces, queries

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(st.one_of(st.sampled_from("abcT he.,'\n\t  é漢😀▁0\x1c"), st.characters(blacklist_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(deadline=None, max_examples=200)
@given(TEXT)
def test_pieces_are_the_library_s(library, text):
    own = pieces.model(PIECES)
    ids = library.encode(text)
    got = own.encode(text)
    assert [p.id for p in got] == ids
    assert own.decode(ids) == library.decode(ids)
    back = library.decode(ids)
    whole = next(own.encode_all([text]))
    assert (whole.line, whole.decoded) == (",".join(map(str, ids)), back)
    raw = text.encode()
    for p in got:
        if p.text.strip("▁") and not p.text.startswith("<0x"):
            assert raw[p.start : p.end].decode().replace(" ", "▁").endswith(p.text.lstrip("▁"))


@pytest.fixture(scope="module")
def mapped(tmp_path_factory):
    """The model with a compiled character map put in, and the library reading it."""
    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    blob = dict(pieces._fields(dict(pieces._fields(norm.serialized_model_proto()))[3]))[2]

    def field(number, data):
        n, size = len(data), []
        while True:
            size.append(n & 127 | (n > 127) << 7)
            n >>= 7
            if not n:
                return bytes([number << 3 | 2, *size]) + data

    path = tmp_path_factory.mktemp("model") / "mapped.model"
    with open(PIECES, "rb") as f:
        path.write_bytes(f.read() + field(3, field(2, blob)))
    return pieces.PieceModel(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))


@settings(deadline=None, max_examples=200)
@given(st.text(st.one_of(st.sampled_from("abT ﬁ½Ａ①é漢​　"), st.characters(blacklist_categories=["Cs"], blacklist_characters="\0")), max_size=40))
def test_pieces_through_a_compiled_map(mapped, text):
    own, library = mapped
    assert own.map.units
    got, want = next(own.encode_all([text])), library.encode(text)
    assert got.ids.tolist() == want and got.decoded == library.decode(want)
    size = len(text.encode())
    assert all(0 <= a <= b <= size for a, b in zip(got.start, got.end, strict=True))
    # pieces stand in the order of their source, and every source byte that is not dropped is covered once
    assert (np.diff(got.start) >= 0).all() and (np.diff(got.end) >= 0).all()


@settings(deadline=None, max_examples=200)
@given(st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="\0"), max_size=40))
def test_normaliser_reads_a_compiled_map(text):
    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    model = pieces.PieceModel(PIECES)
    spec = dict(pieces._fields(norm.serialized_model_proto()))
    model.map = pieces.CharacterMap(dict(pieces._fields(spec[3]))[2])
    model.prefix = model.squeeze = model.escape = False
    got, start, end = model.normalise(text)
    assert got == norm.normalize(text)
    assert all(0 <= a < b <= len(text.encode()) for a, b in zip(start, end, strict=True))


@settings(deadline=None, max_examples=200)
@given(st.lists(TEXT, max_size=4))
def test_words_are_the_library_s(texts):
    own = packing.encoder(WORDS)
    want = [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(texts)] == want


def test_parts_of_words_are_encoded_once(monkeypatch):
    """Case, signs and digits beside a word make no new part of it."""
    own, asked = packing.WordEncoder(WORDS), []
    encode = own._encode_new
    monkeypatch.setattr(own, "_encode_new", lambda words: asked.extend(words) or encode(words))
    texts = ["Word, word. WORD! (word) word2 2word", "«été» été, «été»; don't Don't", "word, word", ""]
    assert [x.tolist() for x in own.encode(texts)] == [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x for x in asked if "word" in str(x)] == [b"word"] and len(asked) == len(set(asked))


@pytest.mark.parametrize("texts", [["A", "\u0301a"], ["J\u030c K", "J\u030c"], ["x's 'S \"'s ''s 's't 'steven"], ["\u0130a \u0130, \u00c9\u0323", "\u00c9T\u00c9"], ["<\u0338", "a <|end", "oftext|> b", "<|endoftext|>C"], ["a\x1cb\x85c\u00a0d"]])
def test_cuts_and_edges_of_texts(texts):
    """Letters before marks, quotes that begin words, letters that lower to more than one, special tokens, odd white space."""
    own = packing.encoder(WORDS)
    want = [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(texts)] == want
    ids, end = own.encode_column(pa.array([b"cut off", *(t.encode() for t in texts)], pa.large_binary()).slice(1), 1)
    assert [x.tolist() for x in np.split(ids, end[:-1])] == [[*x, 1] for x in want]


def test_other_rules_are_left_to_the_tokenizer(tmp_path):
    """A tokenizer that joins across white space gets its texts whole."""
    rules = json.loads(Path(WORDS).read_text()) | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
    (tmp_path / "other.json").write_text(json.dumps(rules))
    own = packing.WordEncoder(str(tmp_path / "other.json"))
    texts = ["In the, Word. the", "", "<|endoftext|> of"]
    assert [x.tolist() for x in own.encode(texts)] == [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


def check(rows, ids, capacity=2048):
    for doc, own in ids.items():
        part = rows[rows.doc_id == doc].sort_values("start")
        assert (part.doc_tokens == len(own)).all()
        assert part.start.tolist() == (part.length.cumsum() - part.length).tolist() and part.length.sum() == len(own)
        for a, n, c in zip(part.start, part.length, part.ids_crc32, strict=True):
            assert zlib.crc32(own[a : a + n].astype("<u4").tobytes()) == c
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= capacity


def test_packing_query(spark):
    rows = queries.op6_harmonic_packing(spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    encoder = packing.encoder(WORDS)
    ids = {d: np.append(np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32), np.uint32(1)) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert set(rows.doc_id) == set(ids)
    check(rows, ids)
    total = rows.groupby("sequence_id").length.sum()
    padding = sum(0 if t & (t - 1) == 0 else 2048 - t for t in total)
    assert padding < 0.01 * total.sum()


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", None), (3, "word " * 5000, "x"), (3, "word " * 5000, "x")], "doc_id long, text string, length string")
    rows = packing.pack(docs, WORDS, with_ids=True).toPandas()
    assert rows[rows.doc_id == 1].doc_tokens.tolist() == [1] and rows.doc_id.isna().sum() >= 1
    assert rows[rows.doc_id == 3].length.sum() == 2 * 5001
    assert packing.pack(docs.where("false"), WORDS).count() == 0


@given(st.integers(1, 10_000))
def test_cuts_cover(total):
    assert sum(packing.cut_points(total)) == total


def test_piece_queries_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.digests(docs, PIECES).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[3].n_tokens > 0
    encoded = pieces.encode(docs, PIECES)
    assert {r.doc_id: r.text for r in pieces.decode(encoded, PIECES).collect()} == {1: "", 2: "", None: "a b", 3: "x" * 50_000}
    assert pieces.digests(docs.where("false"), PIECES).count() == 0
