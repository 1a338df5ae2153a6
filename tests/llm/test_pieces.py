from __future__ import annotations

import hashlib
import random
import struct

import pytest

from corridor_jobs.llm import pieces
from tests.llm.edge_cases import documents, plain


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_ids_and_decoding_equal_the_library(library):
    model, rng = pieces.load(pieces.model_path()), random.Random(4)
    texts = ["", " ", "a  b", "  a ", "\n\nx", "▁x▁", "a\x00b", "\t é 漢字 \U0001f600", "<s>", "</s> <0x0A>", "ﬁ Ａ", "x" * 500, "². 3².5", "▁▁ ▁", "漢" * 99, "ab" * 40 + "c" * 60]
    texts += ["".join(rng.choice(" ▁aébc\n漢\x00the.,1²") for _ in range(rng.randint(1, 120))) for _ in range(600)]
    assert [model.encode(t) for t in texts] == library.encode(texts)
    ids = [[rng.randrange(32000) for _ in range(30)] for _ in range(300)] + [model.encode(t) for t in texts]
    assert [model.decode(i) for i in ids] == [library.decode(i) for i in ids]


def test_spans_cover_the_source_in_order():
    model = pieces.load(pieces.model_path())
    for text in ["Hello  wörld 漢字.", " x", "▁a b", "\U0001f600 a"]:
        starts, ends = model.spans(text)
        data, ids = text.encode(), model.encode(text)
        assert len(starts) == len(ids) and ends[-1] == len(data) and starts == sorted(starts)
        assert all(a <= b for a, b in zip(starts, ends, strict=True))
    starts, ends = model.spans("ab cd")
    assert [b"ab cd"[a:b] for a, b in zip(starts, ends, strict=True)][-1].strip() in (b"cd", b"d")


def compiled_map():
    """A double array for the keys a -> X and ab -> YZ, laid out by hand."""
    size = 1024
    units = [0] * size
    offset = lambda at, base: (base ^ at) << 10
    units[0] = offset(0, 256)
    a = 256 ^ ord("a")
    units[a] = offset(a, 512) | 0x100 | ord("a")
    units[512] = 0x80000000 | 0  # value: offset of "X" in the replacements
    b = 512 ^ ord("b")
    units[b] = offset(b, 400) | 0x100 | ord("b")
    units[400] = 0x80000000 | 2
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *units) + b"X\0YZ\0"


def mapped_model() -> bytes:
    """The model with that map in place of none."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(pieces.model_path(), "rb") as f:
        m = proto.ModelProto.FromString(f.read())
    m.normalizer_spec.precompiled_charsmap = compiled_map()
    return m.SerializeToString()


def test_longest_prefix_of_a_compiled_map():
    m = pieces.CharsMap(compiled_map())
    assert m.longest(b"abc", 0) == (2, b"YZ") and m.longest(b"acb", 0) == (1, b"X") and m.longest(b"ba", 0) is None
    norm, starts, ends = pieces.Model(mapped_model()).normalise("c ab", prefix=True)
    assert (norm, starts, ends) == ("▁c▁YZ", [0, 0, 1, 2, 2], [0, 1, 2, 4, 4])


def byte_spans(library, text):
    """The library's spans in bytes, and where each piece is no byte that a character fell back to."""
    found = library.encode(text, return_type="proto").pieces
    return [(p.begin, p.end) for p in found], [not library.is_byte(p.id) for p in found]


def test_ids_and_spans_with_a_map_and_without_equal_the_library(library):
    import sentencepiece

    mapped, rng = sentencepiece.SentencePieceProcessor(model_proto=mapped_model()), random.Random(6)
    texts = ["ab cab aab", "banana cabs", "x ab", "the cat sat", "é ab né 12, 3"] + ["".join(rng.choice("abab cde thé,1 ") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    for lib, model in ((library, pieces.load(pieces.model_path())), (mapped, pieces.Model(mapped_model()))):
        for text in texts:
            assert model.encode(text) == lib.encode(text)
            want, whole = byte_spans(lib, text)
            got = list(zip(*model.spans(text), strict=True))
            for (start, end), (s, e), is_whole in zip(got, want, whole, strict=True):
                # A piece that ends inside a replacement: the library stops before what was replaced, ours takes it in.
                assert not is_whole or (start == s and (end == e or (lib is mapped and text.encode()[e:end] == b"ab")))


def test_whole_table(spark, library):
    docs = documents(spark, 20)
    got = pieces.encode(docs, ["pieces", "starts", "ends", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]).collect()
    text = dict(plain(docs))
    assert len(got) == docs.count()
    for r in got:
        ids = library.encode(text[r.doc_id])
        assert (r.pieces, r.n_tokens) == (ids, len(ids))
        assert r.spans_sha256 == hashlib.sha256(struct.pack(f"<{2 * len(ids)}i", *r.starts, *r.ends)).hexdigest()
        assert not ids or (r.starts[0], r.ends[-1]) == (0, len(text[r.doc_id].encode()))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode(docs.filter("false"), ["n_tokens"]).isEmpty()
    with pytest.raises(ValueError, match="share names"):
        pieces.encode(docs, ["n_tokens"], keep=("n_tokens",))


def test_normalising_without_a_map_equals_the_general_way():
    plain_model, mapped = pieces.load(pieces.model_path()), pieces.Model(mapped_model())
    rng = random.Random(9)
    for text in ["", " ", "é", "x y", *("".join(rng.choice(" ▁xé漢\U0001f600\n") for _ in range(30)) for _ in range(50))]:  # no key of the map
        for prefix in (True, False):
            assert [list(x) for x in plain_model.normalise(text, prefix)] == [list(x) for x in mapped.normalise(text, prefix)]
