import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb

from cohortloom.llm.piece_codec import Normalizer, PieceCodec, encode_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def random_texts(letters, n, longest, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices(letters, k=draw.randint(0, longest))) for _ in range(n)]


LETTERS = [*"ab  \t\n.é日😀'<s>0x1\0Σİ", "  ", "</s>", "<0x0A>", "the ", " words"]


@pytest.mark.parametrize("letters", [LETTERS, [*LETTERS, "▁"]])
def test_same_as_the_library(letters):
    codec, texts = PieceCodec(PATH), random_texts(letters, 1500, 40, 1)
    for text, (ids, ends, decoded) in zip(texts, codec.encode(texts)):
        expected = codec.library.encode(text)
        assert ids == ",".join(map(str, expected)) and decoded == codec.library.decode(expected)
        assert len(ends) == len(expected) and (np.diff(ends) >= 0).all()
        assert not expected or ends[-1] == len(text.encode())
        assert (ends == codec.spans(text, np.array(expected, np.int64))).all()


def test_spans_spell_the_pieces():
    codec = PieceCodec(PATH)
    text = "Two  words, é and\n日本."
    ids, ends, _ = codec.encode([text])[0]
    raw, start = text.encode(), 0
    for piece, end in zip(map(int, ids.split(",")), ends):
        name = codec.library.id_to_piece(piece)
        shown = bytes([int(name[3:5], 16)]) if codec.library.is_byte(piece) else name.replace("▁", " ").encode()
        assert raw[start:end] in (shown, shown[1:] if start == 0 else shown)
        start = end


def test_whole_texts_when_chunks_are_not_allowed():
    codec = PieceCodec(PATH)
    codec.by_chunk = False
    texts = random_texts(LETTERS, 200, 30, 3)
    assert [(i, list(e), d) for i, e, d in codec.encode(texts)] == [(i, list(e), d) for i, e, d in PieceCodec(PATH).encode(texts)]


def test_small_cache_gives_the_same(monkeypatch):
    monkeypatch.setattr(PieceCodec, "CACHED", 5)
    monkeypatch.setattr(PieceCodec, "CACHED_LENGTH", 3)
    codec, texts = PieceCodec(PATH), random_texts(LETTERS, 300, 30, 4)
    for k in range(0, 300, 10):
        for text, (ids, _, decoded) in zip(texts[k : k + 10], codec.encode(texts[k : k + 10])):
            assert ids == ",".join(map(str, codec.library.encode(text))) and decoded == text


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("blanks", [True, False])
def test_compiled_character_maps(rule, blanks):
    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=blanks
    )
    proto = model_pb.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = Normalizer(proto.normalizer_spec)
    for text in random_texts([*"aＡé①㍿  \tÅﬁﾞẞß가가́e日　"], 800, 20, 2):
        normal, starts, ends = own(text)
        assert normal.decode() == library.normalize(text)
        assert len(starts) == len(ends) == len(normal) and (starts < ends).all() and (np.diff(starts) >= 0).all()


def test_documents(spark, awkward, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = encode_pieces(awkward, PATH, ("ids", "begins", "ends", "decoded", "n_tokens", "ids_sha256")).collect()
    expected = sorted((str(r["doc_id"]), library.encode(r["text"] or "")) for r in awkward.collect())
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == expected
    for r in rows:
        assert r["decoded"] == library.decode(r["ids"]) and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["begins"][1:] == r["ends"][:-1]
    assert encode_pieces(nothing, PATH).count() == 0
