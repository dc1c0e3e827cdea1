import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions.patterns import java_pattern, matches, may_have_hits, required_text

PARTS = [
    "a", "b", "A", "1", "the", "ab", " ", ".", "\\.", "\\d", "\\w", "\\s", "\\b", "[ab]", "[^a]", "[a-z-[aeiou]]", "[\\]a]", "\\x41", "\\u0042",
    "\\x41bc", "\\t", "(ab)", "(?:ab|1)", "(a)", "a?", "b*", "b+", "a{2}", "(ab)?", "\\p{L}", "\\p{Lu}b", "\\(", "\\-", "]", "{", "}", "\\cA", "\\012",
    "^", "$", "(?=ab)", "(?!ab)", "(?'n'a)", "(?i)", "|", "\\Qab\\E", "\\x{41}", "x{0}", "ab{0,1}",
]


def random_patterns(count):
    draw = random.Random(11)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(1, 5))) for _ in range(count)]


def good_patterns(spark, count):
    """Patterns that Java takes in their adapted spelling."""
    compiled = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    good = []
    for pattern in random_patterns(count):
        try:
            compiled(java_pattern(pattern))
            good.append(pattern)
        except Exception:
            continue
    return good


def test_the_text_shortcut_never_changes_a_match(spark):
    draw = random.Random(12)
    texts = ["".join(draw.choice(["a", "b", "A", "B", "c", "1", "the", " ", "\n", ".", "(", "]", "{", "}", "\t", "\x01", "\x0a"]) for _ in range(draw.randint(0, 8))) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).cache()
    good, seen = good_patterns(spark, 2500), 0
    assert len(good) > 1500
    for start in range(0, len(good), 250):
        some = good[start : start + 250]
        rows = frame.select(
            F.array(*[matches(F.col("t"), p) for p in some]).alias("fast"),
            F.array(*[F.col("t").rlike(java_pattern(p)) for p in some]).alias("plain"),
            F.array(*[may_have_hits(F.col("t"), [p]) for p in some]).alias("may"),
        ).collect()
        for row in rows:
            for pattern, fast, plain, may in zip(some, row["fast"], row["plain"], row["may"]):
                assert fast == plain and (may or not plain), pattern
                seen += plain
    frame.unpersist()
    assert seen > 10000


@pytest.mark.parametrize(
    "pattern, text",
    [
        (r"\x41bc", "bc"), (r"\u0041bc", "bc"), (r"\x{41}bc", "bc"), (r"\012ab", None), (r"\cAbc", "bc"), (r"(?<q>x)\k<q>ab", "ab"),
        (r"\p{L}ab\Qx\E", None), (r"(?#note)ab", None), (r"(a)\1bc", None), (r"ab\pLcd?", "ab"),
    ],
)
def test_operands_of_escapes_are_no_text(pattern, text):
    assert required_text(pattern) == text


def test_subtraction_and_quoted_names(spark):
    frame = spark.createDataFrame([(t,) for t in ("bcd", "abe", "e", "z", "aa", "x_1")], "t string")
    hits = lambda p: [r["t"] for r in frame.filter(matches(F.col("t"), p)).collect()]
    assert hits("^[a-z-[aeiou]]+$") == ["bcd", "z"]
    assert hits("^[a-z-[b-y-[e]]]$") == ["e", "z"]
    assert hits("^[^a-d-[x]]$") == ["e", "z"]
    assert hits(r"^(?'n'a)\k'n'$") == ["aa"]
