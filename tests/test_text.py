import re

from pyspark.sql import functions as F

from reviewsift.functions import text as T


def python_clean(s):
    if not s or s == " ":
        return ""
    s = re.sub(r"<[^>]+>", "", s)
    s = re.sub(r"\s+", " ", s)
    return "".join(c for c in s if c.isprintable() or c.isspace())


SAMPLES = [
    None, "", " ", "  ", "plain", "<p>a</p>  b", "a\tb\n\nc\x0bd", "x y z w", "soft­hyphen",
    "zero​width", "ctrl\x00\x07x", "\x1c\x1d sep", "a < b > c", "<>", "emoji \U0001f600 ok", "end ", "\u0085next",
    "﻿bom", "<a\nb>tag", "é è ü", "privateuse",
]


def test_clean_text_matches_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = {r.i: r.c for r in df.select("i", T.clean_text("s").alias("c")).collect()}
    assert got == {i: python_clean(s) for i, s in enumerate(SAMPLES)}


def test_clean_text_every_character_below_3000(spark):
    chars = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(ord(c), f"a{c}b") for c in chars], "i int, s string")
    got = {r.i: r.c for r in df.select("i", T.clean_text("s").alias("c")).collect()}
    # characters newer than the JVM's Unicode tables may differ; none of them is whitespace
    wrong = [i for i in got if got[i] != python_clean(f"a{chr(i)}b")]
    assert all(not chr(i).isspace() for i in wrong) and len(wrong) < 200


def test_word_count_and_strip(spark):
    rows = [s for s in SAMPLES if s is not None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    got = {r.i: (r.n, r.t) for r in df.select("i", T.word_count("s").alias("n"), T.strip("s").alias("t")).collect()}
    assert got == {i: (len(s.split()), s.strip()) for i, s in enumerate(rows)}


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("The Quick brown the fox a x9",), ("",), ("one",), ("of the",)], "s string")
    got = [tuple(r.t) for r in df.select(T.with_bigrams(T.tokens("s")).alias("t")).collect()]
    assert got == [("quick", "brown", "fox", "x9", "quick brown", "brown fox", "fox x9"), (), ("one",), ()]


def test_names(spark):
    df = spark.createDataFrame([("/d/home_and_kitchen_test.csv",), ("books_train_val.parquet",), ("a.b_val.csv",),
                                ("toys",)], "p string")
    assert [r[0] for r in df.select(T.category_from_path("p")).collect()] == [
        "Home And Kitchen", "Books Train", "A.B", "Toys"]
    one = spark.createDataFrame([("Tools & Home",)], "c string")
    assert one.select(T.category_slug("c")).first()[0] == "tools_and_home"


def test_external_tokenizer(spark):
    count = T.external_token_count(lambda: str.split)
    df = spark.createDataFrame([("a b c",), ("",)], "s string")
    assert [r[0] for r in df.select(count("s")).collect()] == [3, 0]


def test_costly_expression_is_evaluated_once(spark):
    df = spark.createDataFrame([("<b>x</b>",)], "s string")
    out = T.computed_once(df, s=T.clean_text("s")).where(F.col("s") != "").select("s", F.length("s"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]+>") == 1 and out.first()[0] == "x"


def test_category_names_are_in_title_case(spark):
    names = ["home_and_kitchen_test", "3d_printers", "arts-crafts_train", "o'neil_4x4_val", "ÉCOLE_été", "a", "", "x1y2"]
    df = spark.createDataFrame([(i, f"/data/{n}.csv") for i, n in enumerate(names)], "i int, p string")
    got = {r.i: r.c for r in df.select("i", T.category_from_path("p").alias("c")).collect()}
    for i, n in enumerate(names):
        stem = re.sub("_(test|train|val)$", "", n) if n else ".csv"
        assert got[i] == stem.replace("_", " ").title(), n


def test_fast_character_classes_equal_the_plain_ones(spark):
    """Every character alone, doubled and between letters: cleaned, counted and cut as by the plain patterns."""
    from reviewsift.functions import text as t

    plain = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
    codes = spark.range(0x110000).where("id not between 55296 and 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    rows = codes.select(F.explode(F.array("c", F.concat("c", "c"), F.concat(F.lit("a"), "c", F.lit("b  - "), "c"))).alias("t"))
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", "<[^>]+>", ""), r"(?U)[\s\x1c-\x1f]+", " "), r"\p{C}", "")
    wrong = rows.where(
        (t.clean_text("t") != F.when(F.col("t") == " ", "").otherwise(cleaned))
        | (t.cleans_to_nothing("t") != (t.clean_text("t") == ""))
        | (t.piece_count("t") != F.regexp_count("t", F.lit(plain)) + 2)
        | (F.array_join(t.tokens("t", []), "|") != F.array_join(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), "|"))
        | (t.first_pieces("t", 2) != F.when(F.regexp_count("t", F.lit(plain)) <= 2, F.col("t")).otherwise(
            F.regexp_extract("t", r"^(?:\s*+(?:[\p{L}\p{N}_]++|[^\p{L}\p{N}_\s])){0,2}+", 0))))
    assert wrong.count() == 0


def test_only_the_pieces_asked_for_are_read(spark):
    """The rest of a long text is not split into pieces: cutting it takes no longer than its beginning."""
    from reviewsift.functions.text import first_pieces

    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(first_pieces("t", 5))
    assert "regexp_extract_all" not in plan._jdf.queryExecution().optimizedPlan().toString()
