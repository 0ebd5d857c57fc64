import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from langmix.llm.encode import PieceEncoder, encode_counts, load, safe_split, tokenizer_path
from langmix.llm.packing import pack
from langmix.llm.token_count import token_counts
from langmix.llm.token_orc import read_token_orc, token_digests, write_token_orc
from langmix.session import scratch_path
from tests.llm import data

NAMES = {"byte_bpe_50k.json": False, "word_bpe_49k.json": True}
TEXT = st.text(st.sampled_from(list("ab'sdZé1!#  \n\n\t\r\x0b\x1c\x85\u00a0\u2003\u0301\u200b\u3000\u4e2d\x01<|>")) | st.characters(exclude_categories=["Cs"]), max_size=60)


def whole(name, text):
    return Tokenizer.from_file(tokenizer_path(name)).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module", params=NAMES)
def name(request):
    return request.param


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(TEXT | st.sampled_from(["word", "<|endoftext|>", "don't", " ", "\n"]), max_size=12), gap=st.sampled_from([" ", "", "\n"]))
def test_pieces_equal_the_whole(parts, gap):
    text = gap.join(parts)
    for name, drops in NAMES.items():
        ids = load(tokenizer_path(name)).encode(text, add_special_tokens=False).ids
        enc = PieceEncoder(tokenizer_path(name), drops)
        assert np.frombuffer(enc.encode([text, text])[1], np.uint32).tolist() == ids
        cut = safe_split(text, 5)
        assert "".join(cut) == text
        assert sum((load(tokenizer_path(name)).encode(c, add_special_tokens=False).ids for c in cut), []) == ids


def test_counts_in_small_calls(name):
    rows = [t for _, t in data.texts(data.awkward())]
    tok = load(tokenizer_path(name))
    assert encode_counts(tok, rows, most=2_000).tolist() == [len(whole(name, t)) for t in rows]


def test_token_counts(spark):
    rows = data.awkward()
    got = token_counts(data.table(spark, rows), tokenizer_path("byte_bpe_50k.json"))
    want = sorted((len(t.encode()), n := len(whole("byte_bpe_50k.json", t)), n > 512, str(i)) for i, t in data.texts(rows))
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit, str(r.doc_id)) for r in got.collect()) == want
    assert token_counts(data.table(spark, []), tokenizer_path("byte_bpe_50k.json")).collect() == []


def test_orc_round_trip(spark):
    rows = data.awkward()
    path = scratch_path(spark, "orc-test")
    write_token_orc(data.table(spark, rows), path, tokenizer_path("word_bpe_49k.json"), 2, True)
    back = read_token_orc(spark, path)
    want = sorted((str(i), whole("word_bpe_49k.json", t) + [2]) for i, t in data.texts(rows))
    assert sorted((str(r.doc_id), r.ids) for r in back.collect()) == want
    start = 0
    got = sorted(token_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    for r in got:
        assert r.start == start
        start += r.n_tokens
    sums = sorted((str(i), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sums
    plan = back.where("doc_id = 205")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,205)" in plan and back.where("doc_id = 205").count() == 1


def test_orc_of_an_empty_table(spark):
    path = scratch_path(spark, "orc-empty")
    write_token_orc(data.table(spark, []), path, tokenizer_path("word_bpe_49k.json"), 2, True)
    assert token_digests(spark, path).collect() == []


def check_packing(got, want, max_tokens, max_segments, max_loss):
    """Every id in one piece; sequences gapless and within the limits; checksums of the right ids."""
    left = {k: [] for k in want}
    for r in got:
        left[r.doc_id].append(r)
    for k, ids in want.items():
        at = 0
        for r in sorted(left[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_tokens and len(pieces) <= max_segments and sum(r.loss_tokens for r in pieces) <= max_loss
    return {k: sum(r.length for r in v) for k, v in seqs.items()}


def test_packing(spark):
    rows = [r for r in data.awkward() if r[0] is not None and r[0] not in (300, 301)]
    want = {i: whole("byte_bpe_50k.json", t) + [1] for i, t in data.texts(rows)}
    for most in (64, 2048):
        got = pack(data.table(spark, rows).coalesce(1), tokenizer_path("byte_bpe_50k.json"), 1, max_tokens=most).collect()
        sizes = check_packing(got, want, most, 256, most)
        assert all(n == most or n & (n - 1) == 0 for n in sizes.values())  # no padding at all
    assert pack(data.table(spark, []), tokenizer_path("byte_bpe_50k.json"), 1).collect() == []
    assert pack(data.table(spark), tokenizer_path("byte_bpe_50k.json"), 1).where("doc_id is null").count() == 2


def test_packing_instruction_data(spark):
    """Limits on all three dimensions; whole examples; loss only on the marked half of each text."""
    rows = [(i, "ask something now please " * (1 + i % 7), [False] * 12 + [True] * 200) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, loss array<boolean>").coalesce(1)
    want = {i: whole("byte_bpe_50k.json", t) + [1] for i, t, _ in rows}
    got = pack(docs, tokenizer_path("byte_bpe_50k.json"), 1, loss_col="loss", max_tokens=128, max_segments=5, max_loss=70, cut=False, pool=50).collect()
    check_packing(got, want, 128, 5, 70)
    assert all(r.length == r.doc_tokens for r in got)
    assert any(r.loss_tokens < r.length for r in got)


@pytest.mark.parametrize("name,drops_space", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_full_memory_keeps_the_pieces_at_hand(monkeypatch, name, drops_space):
    """Pieces that the batch shares with earlier ones are not learned anew, the others are forgotten; ids stay the library's."""
    from langmix.llm import encode

    monkeypatch.setattr(encode, "REMEMBERED", 3)
    enc = encode.PieceEncoder(encode.tokenizer_path(name), drops_space)
    enc.encode(["x alpha beta, gamma délta."])
    learned, learn = [], enc._learn
    monkeypatch.setattr(enc, "_learn", lambda pieces: (learned.extend(pieces), learn(pieces)))
    texts = ["x alpha beta, délta. Ünder new", "x alpha"]
    got = enc.encode(texts)
    assert sorted(learned) == ["new", "Ünder"]
    assert "gamma" not in enc.known
    assert [np.frombuffer(b, np.uint32).tolist() for b in got] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_lines_make_no_pieces_of_their_own():
    """A piece ends where its line does, so the words beside a newline are met again; ids stay the library's."""
    texts = ["Alpha beta.\nAlpha beta.\nalpha beta", "\nbeta.\n\nAlpha", "beta. \nAlpha", "beta \n\nAlpha", "Alpha \n", "Alpha\n\n", "a\n\n\nb", "\n", " ", "", " a ", "don't\nDon't\nЖ\n7"]
    for name, drops in NAMES.items():
        enc = PieceEncoder(tokenizer_path(name), drops)
        got = [np.frombuffer(b, np.uint32).tolist() for b in enc.encode(texts)]
        assert got == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert not any("\n" in p.lstrip("\n") for p in enc.known)
