import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumaspark.llm import bpe, token_files

SPEC = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
OWN = bpe.ByteBpe(SPEC)
LIBRARY = Tokenizer.from_str(SPEC)
LEXICON = bpe.Lexicon(bpe.build_lexicon(OWN, ["the", "of", "and", "that,", "théâtre", "them", "then", "hem"]))
PIECES = bpe.lexicon_encoder(OWN, LEXICON)
TRICKY = [
    "",
    " ",
    "\n\n  x",
    "a  b   c\t d",
    "it's we'll 's 'tis",
    "foo <|endoftext|> bar  <|endoftext|>  ",
    "\x1c \x1d a\x85b \xa0 c d  　e",
    "naïve façade 東京 12３٤ ½ ²",
    "x" * 3000 + " " * 50 + "y",
    "a\r\n b\x0b\x0c c",
    "👩‍👩‍👧 🏳️‍🌈 ́combining",
    "<|endoftext",
    "plain words only,\nand a second line\nthird 's 't, end",
    "\n",
    "one\n",
    " lead",
]


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == want
    for encoder in (PIECES, token_files.library_encoder(SPEC)):
        ids, first = encoder.encode(pa.array([text, None, "a b", text]))
        assert ids[: first[1]].tolist() == want == ids[first[3] :].tolist() and first[1] == first[2]
    assert OWN.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TRICKY)
def test_equals_library(text):
    check(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8", max_codepoint=0x2FFF), st.sampled_from(" \n\t'.aest1é<|>")), max_size=60))
def test_equals_library_on_any_text(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert PIECES.encode(pa.array([text]))[0].tolist() == want
    assert OWN.decode(want) == text


def test_lexicon_is_exact_and_shares_suffixes():
    rng = random.Random(3)
    words = {"".join(rng.choices("abcé", k=rng.randint(1, 7))).encode() for _ in range(500)}
    ids = {w: [rng.randrange(50_000) for _ in range(rng.randint(0, 4))] for w in words}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(ids))
    order = sorted(words)
    assert lexicon.places(order).tolist() == list(range(len(order)))
    assert all(lexicon.ids(i) == packed(ids[w]) for i, w in enumerate(order))
    others = [w + b"z" for w in order[:50]] + [w[:-1] for w in order if w[:-1] not in words] + [b""]
    assert set(lexicon.places(others).tolist()) == {-1}
    assert len(lexicon.final) < sum(map(len, words)) / 3


def test_query_columns(spark):
    rows = [(1, "the cat and the hat"), (2, None), (3, ""), (3, ""), (None, "x"), (5, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as ids", "1 as n_tokens")
    got = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True, lexicon_words=2).collect()
    want = []
    for i, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    full = bpe.encode_decode(docs.where("doc_id = 1"), public_tokenizers.path("byte_bpe_50k.json")).first()
    assert full.decoded == "the cat and the hat" and full.ids == LIBRARY.encode("the cat and the hat").ids
    assert bpe.encode_decode(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
