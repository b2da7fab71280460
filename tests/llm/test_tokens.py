import hashlib

import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers
from sentencepiece import sentencepiece_model_pb2 as proto

from capforge.llm import common, piece_codec, token_counts

BPE, WORD, PIECE = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  a", "it's we'll THE 'S", "x\n\n y\t\tz  \n", "é ½ ² ¼x 3a4 naïve Œuvre", "<|endoftext|> a <|endoftext|>b", "nbsp x\u0085y",
         "日本語 текст \U0001f600", "soft­hyphen", "\x1c\x1d q", "“quoted” — dash", "a" * 5000, "!!! ?? 's", "ﬁne ＡＢ", "▁x ▁", "word " * 3000,
         "it's we'll THE 'S", "a\x00b", "\r\n\r\n x"]
ROWS = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[9])]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("path", [BPE, WORD, PIECE])
def test_counts_are_the_librarys(frame, path):
    if path == PIECE:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = tokenizers.Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    want = sorted((i or -1, len((t or "").encode()), count(t or ""), count(t or "") > 512) for i, t in ROWS)
    out = token_counts.token_counts(frame(ROWS), path).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == want


def test_cache_is_read_and_appended(spark, frame):
    cache = common.shared_path(spark, "cache-test")
    token_counts.token_counts(frame(ROWS), BPE, cache).collect()
    first = spark.read.parquet(cache).count()
    assert first == len({t or "" for _, t in ROWS})
    # what the cache says is believed, another tokenizer's counts are not
    version = token_counts.tokenizer_digest(BPE)
    spark.createDataFrame([(version, bytearray(hashlib.sha256(b"new").digest()), 77), ("other", bytearray(hashlib.sha256(b"else").digest()), 88)],
                          "tokenizer string, digest binary, n_tokens long").write.mode("append").parquet(cache)
    out = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame([(1, "new"), (2, "else"), (3, "")]), BPE, cache).collect()}
    assert out == {1: 77, 2: 1, 3: 0}
    assert spark.read.parquet(cache).count() == first + 3


def test_many_missing_rows_join_by_shuffle(frame, monkeypatch):
    want = sorted(map(repr, token_counts.token_counts(frame(ROWS), BPE).collect()))
    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, token_counts.token_counts(frame(ROWS), BPE).collect())) == want


def test_count_edges(frame):
    assert token_counts.token_counts(frame(ROWS).limit(0), BPE).count() == 0


def test_codec_is_the_librarys(frame):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = []
    for i, t in ROWS:
        ids = model.encode(t or "")
        want.append((-1 if i is None else i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)), ids))
    out = piece_codec.piece_digests(frame(ROWS), PIECE, keep_ids=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in out) == sorted(want)


def test_spans_tile_the_original(frame):
    rows = {r.doc_id: r for r in piece_codec.decode_pieces(piece_codec.encode_pieces(frame(ROWS), PIECE), PIECE).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for i, t in ROWS:
        if i in (None, 4):
            continue
        raw, r = (t or "").encode(), rows[i]
        assert r.decoded == model.decode(list(r.ids))
        assert b"".join(raw[b:e] for b, e in zip(r.begins, r.ends)) == raw
        pieces = [model.id_to_piece(int(k)).replace("▁", " ") for k in r.ids]
        for k, (piece, b, e) in enumerate(zip(pieces, r.begins, r.ends)):
            if not piece.startswith("<0x"):
                assert raw[b:e].decode().replace("▁", " ") == (piece[1:] if k == 0 else piece)
    assert piece_codec.piece_digests(frame(ROWS).limit(0), PIECE).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("collapse", [True, False])
def test_longest_prefix_normalisation(rule, collapse):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True,
                                                    remove_extra_whitespaces=collapse)
    model = proto.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    codec = piece_codec.Codec.__new__(piece_codec.Codec)
    codec.configure(model)
    for text in [t for t in TEXTS if t] + ["ａｂｃ  ①②㍿ ﬁne  ", " é é Å ½ ™\tx y　z\n", "カ゛ガ ｶﾞ 한국 각", "   ", "éx́"]:
        normal, source = codec.normalise(text.encode())
        expected, offsets = library.normalize(text, with_offsets=True)
        assert normal.decode() == expected
        # the library counts characters
        byte = [0]
        for c in text:
            byte.append(byte[-1] + len(c.encode()))
        starts = [source[len(expected[:k].encode())] for k in range(len(expected))]
        assert [int(s) for s in starts] == [byte[o] for o in offsets[:len(starts)]]
