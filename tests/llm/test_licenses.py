import random
from difflib import SequenceMatcher

from odd import LONG, empty_documents, odd_documents

from marginalia.llm.license_texts import NOTICES
from marginalia.llm.licenses import _longest_increasing, align, find_notices, scan_licenses, templates_of

TEMPLATES = templates_of(NOTICES)


def brute_increasing(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        best[i] = 1 + max((best[j] for j in range(i) if pairs[j][1] < pairs[i][1]), default=0)
    return max(best, default=0)


def test_longest_increasing_runs():
    draw = random.Random(1)
    for _ in range(300):
        values = draw.sample(range(100), draw.randint(0, 12))
        pairs = list(enumerate(values))
        run = _longest_increasing(pairs)
        assert len(run) == brute_increasing(pairs)
        assert all(a < b and c < d for (a, c), (b, d) in zip(run, run[1:]))


def test_alignments_are_in_order_and_match():
    draw = random.Random(2)
    for _ in range(500):
        a = [draw.choice("abcdefgh") for _ in range(draw.randint(0, 20))]
        b = [draw.choice("abcdefgh") for _ in range(draw.randint(0, 12))]
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert len(align(b, b)) == len(b)


def test_every_template_is_found_whole_and_with_changes():
    draw = random.Random(3)
    for template in TEMPLATES:
        words = list(template.words)
        text = "Some prose before it. " + " ".join(words).upper() + ". And of the prose after it."
        ((name, coverage, start, end),) = find_notices(text, TEMPLATES)
        assert (name, coverage) == (template.name, 1.0)
        assert text[start:end].lower() == " ".join(words)
        if len(words) > 30:
            for at in draw.sample(range(1, len(words)), len(words) // 10):
                words[at] = "changed"
            found = find_notices("x " + " ".join(words) + " y", TEMPLATES)
            share = sum(b.size for b in SequenceMatcher(None, words, template.words, False).get_matching_blocks())
            assert [f[0] for f in found] == [template.name] and found[0][1] >= share / len(template.words) - 0.05


def test_prose_and_other_licenses_are_left_alone():
    assert find_notices(LONG, TEMPLATES) == []
    assert find_notices("Licensed under some other terms of the company, version 7. All rights of the author.", TEMPLATES) == []
    assert [f[0] for f in find_notices("licensed under CC-BY-NC 4.0", TEMPLATES)] == ["CC-BY-NC-4.0"]
    assert [f[0] for f in find_notices("licensed under CC BY 4.0", TEMPLATES)] == ["CC-BY-4.0"]


def test_repeated_notices_are_all_found():
    line = "Released under the MIT License."
    text = f"{line}\n{line} the under {line}\n" + LONG + " " + line
    assert [text[a:b] for _, _, a, b in find_notices(text, TEMPLATES)] == [line[:-1]] * 4


def test_notices_of_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(
        (r.doc_id, line[:-1]) for r in docs.collect() for line in r.text.split("\n") if "icense" in line and line.endswith(".")
    )
    got = sorted((r.doc_id, r.notice) for r in scan_licenses(docs).collect())
    assert got == want and got


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert scan_licenses(docs).collect() == [] == scan_licenses(empty_documents(spark)).collect()
    one = spark.createDataFrame([(None, "é Released under the MIT License", 1)] * 2, "doc_id long, text string, license int")
    rows = scan_licenses(one).collect()
    assert [(r.doc_id, r.license, r.coverage, r.start, r.notice) for r in rows] == [
        (None, "MIT", 1.0, 2, "Released under the MIT License")
    ] * 2
