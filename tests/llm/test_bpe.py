import hashlib
import random
import unicodedata

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, normalizers

from corpusmill.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "",
    "  ",
    "It's we'LL 'S ''s a'REb 12½ⅷ x\x1cy İstanbul ΑΣ ΣΑΣ. é <|endoftext|> a<|startoftext|><|endoftext|>b <|ENDOFTEXT|>",
    "\U0001f600‍\U0001f600 ᠎ a᠎b     x ﻿ \x85 ﬁ Å ẞ \x00 Ⅳ ٠",
    "a" * 50_000,
    "日本語テスト 한국어 नमस्ते עברית",
    "n't don't I'd've 'tis",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(bpe.read_tokenizer(PATH))


def same(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert list(own.encode(text)) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(own, library, text):
    same(own, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, library, text):
    same(own, library, text)


def test_random_words(own, library):
    draw = random.Random(1)
    for _ in range(500):
        same(own, library, "".join(draw.choice("aeinrst'<|>é. \n12") for _ in range(40)))


def test_every_code_point_beside_marks_is_composed_as_the_library_does():
    compose = normalizers.NFC().normalize_str
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for mark in ("\u0323", "\u0301", "\u0345", "\u07fd", "\U00011930"):
        for start in range(0, len(points), 4096):
            part = points[start : start + 4096]
            for text in (" a".join(c + mark for c in part), " a".join(mark + c for c in part)):
                if bpe.compose(text) != compose(text):
                    wrong = [hex(ord(c)) for c in part for t in (c + mark, mark + c) if bpe.compose("a" + t) != compose("a" + t)]
                    raise AssertionError(f"{mark!r} beside {wrong[:20]}")


def test_marks_among_marks(own, library):
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    draw = random.Random(2)
    for _ in range(3000):
        same(own, library, "e" + "".join(draw.choice(marks) for _ in range(4)) + draw.choice("xÉ \u0301"))


def test_caches_of_two_generations_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 7)
    coder = bpe.WordBpe(bpe.read_tokenizer(PATH))
    draw = random.Random(3)
    for _ in range(200):
        same(coder, library, " ".join(f"word{min(draw.randrange(40), draw.randrange(40))}'s" for _ in range(30)))
        assert len(coder.young) <= 7 and len(coder.old) <= 7


def test_operators(make_docs, library):
    docs = make_docs([*enumerate(ODD), (None, None)], clash=True)
    encoded = bpe.encode(docs, PATH)
    rows = bpe.decode(encoded, PATH).collect()
    assert len(rows) == len(ODD) + 1 and "_gone" in encoded.columns
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    one_pass = bpe.encode_decode(docs, PATH)
    assert one_pass.columns == [*docs.columns, "ids", "decoded"]
    assert sorted(map(str, one_pass.collect())) == sorted(map(str, rows))
    assert bpe.encode(make_docs([]), PATH).collect() == [] == bpe.encode_decode(make_docs([]), PATH).collect()


def test_query(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_word_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
