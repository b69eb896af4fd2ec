import random

from pyspark.sql import functions as F

from strandlake.llm.reading import BOUNDS, _familiar, _take_apart, plain, reading_levels, sentence_count, words

DOCS, RATINGS = "d bigint, t string", "ident bigint, rater string, level int"
EASY = "the dog can see a small red ball and we all like to run in the sun with him".split()
HARD = "stoichiometry heteroskedastic marginalisation orthogonal covariates posterior identifiability panmixia".split()


def corpus(n=240):
    rng = random.Random(3)
    docs, ratings = [], []
    for i in range(n):
        level = i % 5 + 1
        share = (level - 1) / 5
        sentences = [" ".join(rng.choice(HARD if rng.random() < share else EASY) for _ in range(rng.randrange(5, 12))) for _ in range(12)]
        text = (". " if i % 3 else "\n").join(sentences)
        docs.append((i, text.upper() if i % 7 == 0 else f"<p>{text}</p>"))
        if i % 2:
            ratings.append((i, "r1", level))
    return docs, ratings


def test_held_out_levels(spark):
    docs, ratings = corpus()
    df = spark.createDataFrame(docs + docs[:10], DOCS).withColumns({c: F.lit(1) for c in ("ident", "text", "words", "level")})
    out = {r["d"]: r for r in reading_levels(df, "d", "t", spark.createDataFrame(ratings + ratings[:5] + [(1, "r2", None), (None, "r1", 3), (9999, "r1", 2)], RATINGS)).collect()}
    assert len(out) == len(docs)
    held = [i for i, _ in docs if i % 2 == 0]
    assert sum(out[i]["specialist"] == (i % 5 >= 3) for i in held) >= 0.9 * len(held)
    assert sum(abs(out[i]["level"] - (i % 5 + 1)) <= 1 for i in held) >= 0.9 * len(held)


def test_texts_without_words_and_no_ratings(spark):
    docs, ratings = corpus(60)
    odd = [(1000, None), (1001, ""), (1002, "12 34 5.6"), (1003, "ACGTACGTACGTACGT"), (1004, "word " * 20_000)]
    out = {r["d"]: r for r in reading_levels(spark.createDataFrame(docs + odd, DOCS), "d", "t", spark.createDataFrame(ratings, RATINGS)).collect()}
    assert len(out) == 65 and all(out[i]["level"] is None and out[i]["specialist"] is None for i in (1000, 1001, 1002, 1003)) and out[1004]["level"] is not None
    none = reading_levels(spark.createDataFrame(docs, DOCS), "d", "t", spark.createDataFrame([], RATINGS)).collect()
    assert len(none) == 60 and all(r["level"] is None for r in none)
    assert reading_levels(spark.createDataFrame([], DOCS), "d", "t", spark.createDataFrame(ratings, RATINGS)).collect() == []


def test_words_and_sentences():
    text = "<b>The dog's</b> k2 ball; see p. 7!\n- one\n- two &amp; three? NNNNNNNNACGT 42"
    assert words(plain(text)) == ["the", "dog's", "ball", "see", "p", "one", "two", "three"]
    assert sentence_count(plain(text)) == 3  # "7!" has no word


def test_lists_hold_words_by_document_frequency(spark):
    rows = [(i, "the of " + ("and " * 3 if i % 2 else "") + (f"only{chr(97 + i)} " if i < 20 else "")) for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "ident bigint, text string").mapInArrow(_take_apart, "ident bigint, sentences int, words array<string>, times array<int>")
    place = _familiar(df)
    assert set(place) == {"the", "of", "and"} and place["the"] == 0 and abs(BOUNDS[place["and"]] - 0.5) < 0.1 and BOUNDS[place["and"]] <= 0.5
    out = {r["d"]: r for r in reading_levels(spark.createDataFrame(rows, DOCS), "d", "t", spark.createDataFrame([], RATINGS)).collect()}
    assert abs(out[1]["unfamiliar"] - 1 / 6) < 1e-9 and out[21]["unfamiliar"] == 0.0 and out[1]["sentence"] == 6.0 and out[901]["unfamiliar"] is None


def test_very_many_open_brackets_and_a_long_run_of_letters():
    assert words(plain("<" * 50_000 + " end")) == ["end"] and words(plain("a" * 50_000 + "1")) == []
