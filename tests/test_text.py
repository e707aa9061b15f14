import hashlib

import pytest
from pyspark.sql import functions as F

from foliomill.functions import layout
from foliomill.functions import text as tx

# (text, cleaned with tokens for numbers, cleaned with numbers deleted)
CASES = [
    (
        "This is PAGE 1 of the document. ISO 9001 certified.",
        "this is  of the document standard certified",
        "this is  of the document  certified",
    ),
    (
        "See page 12 and Section IV, section xiv; sections ix stay. Page12 stays, page 12a stays.",
        "see  and   sections ix stay page stays page a stays",
        "see  and   sections ix stay page stays page a stays",
    ),
    (
        "Part 12-34 and 12-34-56, x12-34 stays, 12-34y stays, 1-2.",
        "part partnum and partnum x stays y stays partnum",
        "part  and  x stays y stays ",
    ),
    (
        "IEC 60204 DIN 912 iso 9001 Iso 9001 ISO9001 ISO 9001b",
        "standard standard iso  iso  iso iso b",
        "    iso iso b",
    ),
    (
        "don't foo-bar e-mail 50% na\xefve caf\xe9 \xe912-34 12-34\xe9 page 3\xe9",
        "dont foobar email  nave caf   page ",
        "dont foobar email  nave caf   page ",
    ),
    # Unicode spaces and separators, digits of other scripts, combining marks.
    ("a\xa0b\u2003c\x1cd\te\nf page\xa07 section\u2003ii", "a\xa0b\u2003c\x1cd\te\nf  ", "a\xa0b\u2003c\x1cd\te\nf  "),
    ("page \u0661\u0662 \u0661-\u0662 \xb2-\xb3 x\u0301 12-3\u0301", " partnum  x partnum", "   x "),
    ("", "", ""),
    ("   ", "   ", "   "),
    ("PAGE 1PAGE 2 page 3 page 4", "page page   ", "page page   "),
]


def test_cleaning_and_tokens(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    text = F.col("t")
    got = df.select(
        "i",
        tx.clean(text, "replace").alias("r"),
        tx.clean(text, "delete").alias("d"),
        tx.tokens(tx.clean(text, "replace")).alias("w"),
    ).collect()
    for row in got:
        _, replaced, deleted = CASES[row.i]
        assert (row.r, row.d) == (replaced, deleted)
        # The separator characters count as space for Python's split as well.
        assert row.w == replaced.split()


def test_null_text_is_empty_and_profile_is_checked(spark):
    row = spark.sql("select cast(null as string) t").select(tx.clean_replace(F.col("t")).alias("c"), tx.tokens(tx.clean_delete(F.col("t"))).alias("w")).first()
    assert row.c == "" and row.w == []
    with pytest.raises(ValueError):
        tx.clean(F.lit("x"), "other")


def test_stopwords_keep_order_and_repeats(spark):
    words = tx.without_stopwords(tx.tokens(F.lit("the pump and the valve and pump this is of")))
    assert spark.range(1).select(words.alias("w")).first().w == ["pump", "valve", "pump"]
    sentence = tx.clean_replace(F.lit("This is PAGE 1 of the document. ISO 9001 certified."))
    assert spark.range(1).select(tx.joined(tx.without_stopwords(tx.tokens(sentence))).alias("w")).first().w == "document standard certified"


def test_terms_are_unigrams_then_bigrams_of_long_tokens(spark):
    def terms(t):
        return spark.range(1).select(tx.terms(tx.long_tokens(tx.tokens(F.lit(t)))).alias("t")).first().t

    assert terms("ab c de fg") == ["ab", "de", "fg", "ab de", "de fg"]
    assert terms("ab") == ["ab"]
    assert terms("") == []


def test_text_hash_is_md5_of_utf8(spark):
    assert spark.range(1).select(tx.text_hash(F.lit("naïve")).alias("h")).first().h == hashlib.md5("naïve".encode()).hexdigest()


def test_cheap_looks_for_fixed_strings_change_nothing(spark):
    """Patterns that need a hyphen, a standard's name or a tag are skipped where there is none."""
    texts = [
        None, "", "plain", "12-34 a", "a 12-34", "-", "x-1-2", "ISO 9001 and 7-8", "IS page 3 O 9", "DIN", "IEC 61", "din 5", "a < b", "<p>x</p>",
        "<div >a<br/>b", "PART page 1 2-3 ISO 4", "xISO 3", "ISO\u00a09", "1 page 2-3", "<", "a>b", "section iv-2 DIN 1-2", "page 1-2", "ISO page 5 6", "\u0130SO 1",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = F.coalesce("t", F.lit(""))
    for pattern, put in ((r"(?iu)" + tx._whole(tx.PAGE_OR_SECTION, "ps"), ""), (tx._whole(tx.PART_NUMBER, tx.DIGIT), "PARTNUM"), (tx._whole(tx.STANDARD, "ID"), "STANDARD"), (tx.NOT_LETTER_OR_SPACE, "")):
        out = F.regexp_replace(out, F.lit(pattern), F.lit(put))
    size, count = F.length("t").cast("double"), lambda x: F.regexp_count("t", F.lit(x)).cast("double")
    plain = F.array(count(layout.TAG) / size, count(layout.BLOCK_OPEN), F.length(F.regexp_replace("t", F.lit(layout.TAG), F.lit(""))) / size, size)
    plain = F.when(F.coalesce(F.length("t"), F.lit(0)) > 0, plain).otherwise(F.array(*[F.lit(0.0)] * 4))
    for r in df.select("t", F.lower(out).alias("want"), tx.clean_replace(F.col("t")).alias("got"), plain.alias("a"), layout.layout_features(F.col("t")).alias("b")).collect():
        assert r.want == r.got and r.a == r.b, r
