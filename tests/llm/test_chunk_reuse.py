import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from hashlib import sha256
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import empty_documents, odd_documents
from tokenizers import Tokenizer

from marginalia.llm import chunk_reuse
from marginalia.llm.chunk_reuse import MAX_CHUNK, MIN_CHUNK, WordEncoder, chunked, encode, joined, read_tokenizer
from marginalia.llm.tokens import op12_chunk_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
MODEL = read_tokenizer(PATH)
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
ENCODER = WordEncoder(MODEL)


def whole(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def chunks_of(text):
    (content, ends), = chunked(pa.array([text]))
    return [bytes(content[a:b]) for a, b in zip([0, *ends], ends)]


def by_parts(parts):
    names = ["codes", "head", "head_n", "tail", "tail_n"]
    return ENCODER.ids(joined([dict(zip(names, ENCODER.coded(part))) for part in parts], ENCODER)).tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(), st.lists(st.integers(0, 40), max_size=8))
def test_any_cut_is_repaired(text, at):
    places = sorted({min(x, len(text)) for x in at} | {0, len(text)})
    parts = [text[a:b].encode() for a, b in zip(places, places[1:])]
    assert by_parts(parts) == whole(text)


def test_words_with_odd_white_space_and_special_strings():
    odd = ["a\x0bb", "a\x1cb c\x85d", "x y z", "é ́e", "AİΣ Σ", "<|endoftext|>x <|start oftext|>", "it's 'S 12½", "\n\t", "🙂🙂 漢字かな"]
    for text in odd:
        for cut in range(len(text) + 1):
            assert by_parts([p for p in (text[:cut].encode(), text[cut:].encode()) if p]) == whole(text), (text, cut)
        ids = np.array(whole(text), dtype=np.int32)
        assert ENCODER.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_every_plain_character_and_a_small_memo(monkeypatch):
    plain = [chr(c) for c in range(0x250) if chunk_reuse.PLAIN(chr(c))]
    rng = random.Random(1)
    texts = [a + b for a in plain for b in ("", "'s", "x", "1")] + ["".join(rng.choices(plain, k=rng.randint(1, 12))) for _ in range(5000)]
    monkeypatch.setattr(chunk_reuse, "MEMO_PIECES", 50)
    small = WordEncoder(MODEL)
    for text in texts + texts[:100]:
        assert small.ids(small.encode(text.encode())).tolist() == whole(text), text


def test_chunks_follow_the_content():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeféß漢", k=rng.randint(1, 9))) for _ in range(500)]
    passage = " ".join(rng.choices(words, k=3000))
    one, other = " ".join(rng.choices(words, k=700)) + passage, "short" + passage + "end"
    first, second = chunks_of(one), chunks_of(other)
    assert b"".join(first) == one.encode() and b"".join(second) == other.encode()
    assert all(MIN_CHUNK <= len(c) <= MAX_CHUNK + 3 for c in first[:-1])
    assert all(c.decode() for c in first)
    assert len(set(first) & set(second)) > 0.7 * len(second)
    assert [len(c) for c in chunks_of("a" * 10_000)][:2] in ([MIN_CHUNK] * 2, [MAX_CHUNK] * 2)
    texts = pa.array(["x", None, one, "", other]).slice(1)
    found = [[bytes(c[a:b]) for a, b in zip([0, *ends], ends)] for c, ends in chunked(texts)]
    assert found == [[], first, [], second]


def check(rows, text="text"):
    for row in rows:
        ids = whole(row[text])
        assert row.ids == ids and row.decoded == LIBRARY.decode(ids, skip_special_tokens=False)


def test_shared_passages_copies_and_long_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij'.,", k=rng.randint(1, 9))) for _ in range(300)]
    passage = " ".join(rng.choices(words, k=400))
    texts = ["".join([" ".join(rng.choices(words, k=rng.randint(0, 300))), passage, rng.choice(["", "tail", " t"])]) for _ in range(60)]
    texts += texts[:10] + ["ab" * 20_000, "ab" * 20_000 + "c", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    coded = encode(docs, MODEL, decoded="decoded").collect()
    assert len(coded) == len(texts)
    check(coded)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words " * 200), (2, "other words, " * 90)], "doc_id long, text string")
    monkeypatch.setattr(chunk_reuse, "_shared_filter", lambda counts: b"\xff" * (1 << (chunk_reuse.FILTER_BITS - 3)))
    check(encode(docs, MODEL, decoded="decoded").collect())


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    coded = encode(docs, MODEL, decoded="decoded")
    assert set(coded.columns) == set(docs.columns)
    rows = coded.collect()
    assert len(rows) == docs.count()
    check(rows)
    assert encode(docs, MODEL, ids="text").columns.count("text") == 1
    empty = encode(empty_documents(spark), MODEL, decoded="decoded")
    assert empty.count() == 0


def test_query_equals_the_library(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op12_chunk_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = whole(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
