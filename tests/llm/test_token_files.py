"""Packed token ids: round trips, random access, damage, order, and every row against the library."""

from __future__ import annotations

import io
import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestream.llm import queries, tokenbits
from lodestream.llm.common import filesystem, shared_folder
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@given(st.integers(1, 32), st.data())
@settings(max_examples=60, deadline=None)
def test_pack_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=70)), np.uint32)
    packed = tokenbits.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert tokenbits.unpack(packed, bits, len(ids)).tolist() == ids.tolist()
    whole = sum(int(x) << (bits * i) for i, x in enumerate(ids))
    assert packed == whole.to_bytes(len(packed), "little")


def file_of(ids_by_doc, vocabulary=1000, block=64):
    sink = io.BytesIO()
    sink.close, close = lambda: None, sink.close
    writer = tokenbits.Writer(sink, vocabulary, block)
    for doc, ids in ids_by_doc:
        writer.add(np.array(ids, np.uint32))
        writer.end(doc)
    writer.close()
    return sink.getvalue()


def test_random_access():
    rng = np.random.default_rng(5)
    docs = [(i if i != 3 else None, rng.integers(0, 1000, n).tolist()) for i, n in enumerate([0, 5, 300, 64, 1, 0, 2000])]
    held = tokenbits.Reader(pa.BufferReader(file_of(docs)))
    assert held.bits == 10 and held.nulls.tolist() == [i is None for i, _ in docs]
    for n, (_, ids) in enumerate(docs):
        assert held.document(n).tolist() == ids
    flat = [x for _, ids in docs for x in ids]
    for a, b in [(0, len(flat)), (63, 65), (64, 128), (100, 100), (2000, len(flat))]:
        assert held.ids(a, b).tolist() == flat[a:b]


def test_damage_and_bounds():
    raw = bytearray(file_of([(1, range(200))]))
    raw[tokenbits.HEAD.size + 90] ^= 1
    held = tokenbits.Reader(pa.BufferReader(bytes(raw)))
    with pytest.raises(ValueError, match="block 1"):
        held.ids(0, 200)
    assert held.ids(0, 64).tolist() == list(range(64))
    with pytest.raises(ValueError, match="beyond"):
        file_of([(1, [1000])])
    with pytest.raises(ValueError, match="cut short"):
        tokenbits.Reader(pa.BufferReader(bytes(raw[:-1]) + b"x"))


ODD = ["", "Don't STOP!! it's 3.14", "word<|endoftext|>, <|ENDOFTEXT|> <|startoftext|>x", "J̌azz Ångstrom Y̊", "日本語 ☆ … ﬁne", "a" * 5000, "tab\tsep\x0bx\x0cy\x1cz", "l'été, (naïve). \"Ünï\"!?", "ΑΣ ΟΔΟΣ. İstanbul", "é. x́, z."]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_what_the_library_gives(name, documents, monkeypatch):
    monkeypatch.setattr(tokenbits, "WINDOW", 256)
    monkeypatch.setattr(tokenbits, "REMEMBERED", 500)
    encoder, library = tokenbits.Encoder(name), Tokenizer.from_file(public_tokenizers.path(name))
    texts = ODD + [r.text or "" for r in documents.select("text").limit(60).collect()]
    for some in ([t] for t in texts), (texts[i : i + 7] for i in range(0, len(texts), 7)):
        for batch in some:
            found = [b""] * len(batch)
            for i, ids in encoder.encode([t.encode() for t in batch]):
                found[i] += ids
            assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in batch]


PIECES = ["ab", "É", "é", "ü", "ß", "×", "÷", "Σ", "ς", "İ", "ﬁ", "7", "²", "_", "'s", "'", "’", "it's", "\u0301", "\u0338", "\u0345", "…", "日本", "ª", "<|endoftext|>", "<|", "|>", "endoftext", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2028", "\0", "\U0001f600", "\u1100", "\u1161", *string.punctuation]


@pytest.fixture(scope="module")
def both():
    return tokenbits.Encoder("word_bpe_49k.json"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=4))
@settings(max_examples=300, deadline=None)
def test_odd_words(both, texts):
    encoder, library = both
    found = [b""] * len(texts)
    for i, ids in encoder.encode([t.encode() for t in texts]):
        found[i] += ids
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_goes_to_the_library_once_whatever_marks_follow():
    encoder, asked = tokenbits.Encoder("word_bpe_49k.json"), []

    class Asked:
        def __init__(self, library):
            self.library = library

        def encode(self, text, **how):
            asked.extend(text.split())
            return self.library.encode(text, **how)

        def encode_batch_fast(self, texts, **how):
            asked.extend(x for t in texts for x in t.split())
            return self.library.encode_batch_fast(texts, **how)

    library = encoder.tokenizer
    encoder.tokenizer = Asked(library)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeé" for c in ("st", "nü", "r")]
    tails = ["", *(m * 3 for m in "$%&*#.,"), ".***", ",&&&"]
    text = " ".join(w + t for t in tails for w in words)
    for _ in range(2):
        assert np.frombuffer(b"".join(x for _, x in encoder.encode([text.encode()])), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(asked) <= len(words) + len(tails)


def brute(rows):
    library, at, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    assert sorted(map(tuple, queries.op11_token_ids(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == brute(rows)


def test_odd_rows_and_many_files(spark, odd, empty):
    folder = shared_folder(spark, "odd")
    files = tokenbits.write_ids(odd, folder, file_ids=50)
    assert files.count() > 3
    found = sorted(map(tuple, tokenbits.read_digests(spark, folder).collect()), key=lambda r: r[1])
    ids = [r[0] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((str(r[0]), r[2], r[3]) for r in found) == sorted((str(r[0]), r[2], r[3]) for r in brute(rows))
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found[:-1])]).tolist()
    fs, base = filesystem(folder)
    with fs.open_input_file(f"{base}/{files.orderBy('start').first().file}") as source:
        assert tokenbits.Reader(source).bits == 16
    nothing = shared_folder(spark, "nothing")
    assert tokenbits.write_ids(empty, nothing).count() == 0 and tokenbits.read_digests(spark, nothing).count() == 0
