import struct

import pytest
import sentencepiece

from mise.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S.read_model())


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL_PATH)


ODD = ["", " ", "  a   b", "日本語 ✓ 🙂\n\t x", "<s> </s> <unk> <0x41>", "a\x00b", " lead", "trail  ", "ﬁ ½ é", "x" * 500, "\n\n a\n", " \n ",
       "don't (stop)... U.S.A. «oui» “no”, 3.14, a_b-c @x #y $z", "नमस्ते दुनिया", "مرحبا بالعالم", "12,345.67 00"] + \
      ["a" + " " * k + "b\n" + " " * k for k in range(40)]


def test_ids_equal_the_library_and_decode_back(codec, lib, documents):
    texts = ODD + [r.text for r in documents.collect()]
    for t, (ids, back, same) in zip(texts, codec.encode(texts)):
        assert ids.tolist() == lib.encode(t) and back and same
        assert ids.tolist() == codec.whole.encode(t, add_special_tokens=False).ids  # cutting changes nothing
        assert codec.whole.decode(ids.tolist(), skip_special_tokens=False) == t


def test_a_marker_in_the_text_is_no_round_trip(codec, lib):
    (ids, back, same), = codec.encode(["▁x"])
    assert ids.tolist() == lib.encode("▁x") and same and not back


def test_full_cache_starts_anew(lib):
    small = S.Codec(S.read_model(), kept_bytes=12_000)
    texts = ["the quick brown fox", "jumps over the lazy dog " * 9, "again the quick one"]
    for _ in range(3):
        for t in texts:
            assert small.encode([t])[0][0].tolist() == lib.encode(t)


def test_encode_and_decode_tables(spark, make_docs, odd_rows, lib):
    docs = make_docs([*odd_rows, *((100 + i, t) for i, t in enumerate(ODD))], clash=("ids", "n_tokens", "decoded"))
    rows = S.decode(S.encode(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.text is None:
            assert r.ids is None and r.n_tokens == 0 and r.decoded is None and r.parity is None
        else:
            assert r.ids == lib.encode(r.text) and r.n_tokens == len(r.ids) and r.decoded == r.text and r.parity and r.round_trip
    assert S.encode(make_docs([])).count() == 0


def _field(number, wire, value):
    def varint(n):
        out = b""
        while True:
            n, low = n >> 7, n & 127
            out += bytes([low | (128 if n else 0)])
            if not n:
                return out
    body = varint(value) if wire == 0 else value if wire == 5 else varint(len(value)) + value
    return varint(number << 3 | wire) + body


def unigram_model(squeeze):
    """A small unigram model with byte fallback, written by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = ["▁", "▁the", "▁th", "e", "t", "h", "▁cat", "▁c", "at", "a", "c", "s", "▁s", "▁sat", "ts", "cats", "i", "n", "▁in", "in"]
    pieces += [(w, -1.5 - 0.37 * i, 1) for i, w in enumerate(words)]
    out = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, k)) for p, s, k in pieces)
    out += _field(2, 2, _field(3, 0, 1) + _field(4, 0, len(pieces)) + _field(35, 0, 1))
    return out + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, 1) + _field(4, 0, int(squeeze)) + _field(5, 0, 1))


@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_models(squeeze):
    blob = unigram_model(squeeze)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=blob)
    texts = ["the cats sat in", "cat", "thecat  in é the", "x ✓ tthhee", " the  cat ", "satin in\nsat"]
    for t, (ids, _, same) in zip(texts, S.Codec(blob).encode(texts)):
        assert ids.tolist() == theirs.encode(t) and same


def test_bad_models_are_refused(tmp_path):
    with pytest.raises(ValueError):
        S.parse_model(_field(2, 2, _field(3, 0, 3)))
    with pytest.raises(ValueError):
        S.parse_model(unigram_model(False) + _field(1, 2, _field(1, 2, b"own") + _field(3, 0, 4)))
    big = tmp_path / "m.model"
    big.write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        S.read_model(str(big), most=10)
