import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from odd import empty_documents, odd_documents
from tokenizers import Tokenizer

from marginalia.llm.byte_bpe import Encoder, RankError, decode, encode, read_ranks
from marginalia.llm.pieces import piece_finder
from marginalia.llm.token_counts import Counter, count_tokens, read_model
from marginalia.llm.tokens import bpe_digests

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_ranks(RANKS))


def random_texts(count, seed):
    draw = random.Random(seed)
    kinds = [
        lambda n: "".join(chr(draw.randint(0, 127)) for _ in range(n)),
        lambda n: "".join(chr(draw.choice([draw.randint(0, 0x24F), draw.randint(0x250, 0x2FFF)])) for _ in range(n)),
        lambda n: "".join(chr(c) for c in (draw.randint(0, 0x3FFFF) for _ in range(n)) if not 0xD800 <= c < 0xE000),
        lambda n: "".join(draw.choice(["th", "on", "er", "$$$", " ", "ing", "é", "\n", "'s"]) for _ in range(n)),
        lambda n: draw.choice(" aA=-\n\t\x85\u3000") * n * 3 + "x",
        lambda n: "".join(draw.choice(" \n<|endoftext|>") for _ in range(n)) + "<|endoftext|>",
    ]
    return [kinds[k % len(kinds)](draw.randint(0, 50)) for k in range(count)]


def test_encoding_equals_the_library(library, encoder):
    find = piece_finder()
    for text in random_texts(3000, 1):
        assert [i for piece in find(text) for i in encoder.encode(piece)] == library.encode_ordinary(text), text


def test_long_pieces_take_linear_work(encoder, library):
    for piece in ("a" * 100_000, "ab" * 50_000 + "c", "=" * 99_999):
        assert list(encoder.encode(piece)) == library.encode_ordinary(piece)


def test_a_rank_file_needs_all_bytes():
    with pytest.raises(RankError):
        Encoder(b"YQ== 0\n")


def test_counts_equal_the_library():
    model, find = read_model(MODEL), piece_finder()
    counter, library = Counter(model["merges"]), Tokenizer.from_file(MODEL)
    for text in random_texts(3000, 2):
        parts = text.split("<|endoftext|>")
        count = len(parts) - 1 + sum(counter.count(piece) for part in parts for piece in find(part))
        assert count == len(library.encode(text, add_special_tokens=False).ids), text


def test_odd_documents_encode_and_decode(spark, library):
    docs, ranks = odd_documents(spark), read_ranks(RANKS)
    coded = encode(docs, ranks, decoded="decoded")
    assert set(coded.columns) == set(docs.columns)
    rows = coded.collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert row.ids == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode() and row.n_tokens == "7"
    for row in decode(coded.select("text", "ids"), ranks).collect():
        assert bytes(row.decoded) == (row.text or "").encode()
    over_text = encode(docs.select("text"), ranks, ids="text")
    assert over_text.columns == ["source_text", "text"]
    assert encode(empty_documents(spark), ranks).collect() == []


def test_digests_equal_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in bpe_digests(docs, RANKS).collect()}
    for row in docs.collect():
        ids = library.encode_ordinary(row.text)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want = (len(ids), digest, hashlib.sha256(row.text.encode()).hexdigest())
        assert (got[row.doc_id].n_tokens, got[row.doc_id].ids_sha256, got[row.doc_id].decoded_sha256) == want


def test_odd_documents_are_counted(spark):
    library = Tokenizer.from_file(MODEL)
    docs = odd_documents(spark)
    rows = count_tokens(docs, read_model(MODEL)).collect()
    assert len(rows) == docs.count()
    for row in rows:
        text = row.text or ""
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert count_tokens(empty_documents(spark), read_model(MODEL)).collect() == []


def test_counts_of_whole_table(spark, sf_dir):
    library = Tokenizer.from_file(MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = count_tokens(docs, read_model(MODEL)).collect()
    counts = [len(e.ids) for e in library.encode_batch([r.text for r in rows], add_special_tokens=False)]
    assert [r.n_tokens for r in rows] == counts
