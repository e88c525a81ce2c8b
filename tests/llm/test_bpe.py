"""Backtracking BPE against tiktoken, and back to the bytes."""

import array
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from helpers import documents, odd_rows

from touchline.llm import bpe_backtrack as B

FILES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")


def tik(name):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(P.path(name)), special_tokens={})


@pytest.mark.parametrize("name", FILES)
def test_random_texts(name):
    enc, rnd, path = tik(name), random.Random(7), P.path(name)
    for i in range(3000):
        n = rnd.randint(0, 80)
        alphabet = "abcdefgeeeeiiion   ttthh\n\r\x1c\x85'sé中ñ12 　\U0001F600<|endoftext|>"
        s = "".join(rnd.choice(alphabet) if i % 2 else chr(rnd.choice([rnd.randint(0, 0x2ff), rnd.randint(0x300, 0xd7ff), rnd.randint(0x20, 0x7e)])) for _ in range(n))
        ids = B.encode_text(s, path, P.PATTERN)
        assert array.array("I", ids).tolist() == enc.encode_ordinary(s)
        assert B.decode_ids(ids, path, P.PATTERN) == s.encode()


def test_single_pieces_without_short_cut():
    """Backtracking itself, piece by piece, also where the whole piece is a token."""
    encoder, enc, rnd = B.BacktrackEncoder(B.read_ranks(P.path(FILES[0]))), tik(FILES[0]), random.Random(8)
    for _ in range(3000):
        piece = bytes(rnd.choice(b"aabbccddeethern \xc3\xa9\xff") for _ in range(rnd.randint(2, 30)))
        assert encoder.encode_piece(piece) == enc._encode_single_piece(piece)


def test_long_piece_is_linear():
    path, enc = P.path(FILES[0]), tik(FILES[0])
    for s in ("a" * 50_000, "ab" * 5_000 + "the" * 999, "\n" * 5_000, " " * 3_001 + "x"):
        assert array.array("I", B.encode_text(s, path, P.PATTERN)).tolist() == enc.encode_ordinary(s)


def test_rows(spark):
    rows, enc = odd_rows(random.Random(9)), tik(FILES[0])
    got = B.digests(B.encode(documents(spark, rows, clash=True), P.path(FILES[0]), P.PATTERN)).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = enc.encode_ordinary(text or "")
        want.append((str(doc_id), len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert B.encode(documents(spark, []), P.path(FILES[0]), P.PATTERN).count() == 0


def test_bad_vocabulary():
    with pytest.raises(ValueError):
        B.BacktrackEncoder({b"a": 0})
