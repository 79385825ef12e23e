import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofsearch.functions import text as T
from proofsearch.functions import units as U


def one(spark, expr, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names)).select(expr.alias("x")).first()["x"]


def test_words_and_stems(spark):
    c = F.col("t")
    assert one(spark, T.words(c), t="Le prix ÉLEVÉ: 4,5 kg et 16Go!") == ["le", "prix", "eleve", "4,5", "kg", "et", "16go"]
    assert one(spark, T.content_words(c), t="The exceptions, exceptions of a rule b") == ["exception", "exception", "rule"]
    assert one(spark, T.stem(c), t="remboursements") == "rembours" and one(spark, T.stem(c), t="ab12es") == "ab12es" and one(spark, T.stem(c), t="uses") == "uses"
    assert one(spark, T.identifiers(c), t="A4 b A4 7") == ["a4", "7"]
    assert one(spark, T.strip_accents_any(c), t="ﬁn ² é") == "fin 2 e"


def test_sentences_and_chunks(spark):
    c = F.col("t")
    assert one(spark, T.split_sentences(c), t=" One 4.5 kg. Two; three\n\nFour! ") == ["One 4.5 kg.", "Two;", "three", "Four!"]
    text = " ".join(f"Sentence number {k} has some words in it." for k in range(40))
    chunks = one(spark, T.chunk_text(c, 30), t=text)
    assert " ".join(chunks) == text and all(len(x) <= 130 for x in chunks) and len(chunks) > 10
    assert one(spark, T.chunk_text(c), t="") == [] and one(spark, T.estimate_tokens(c), t="abcde") == 2


def test_phrases_quotes_titles(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, T.has_phrase(a, b), a="sauf exceptions prévues", b="exception")
    assert not one(spark, T.has_phrase(a, b), a="il peut tourner", b="tour") and not one(spark, T.has_phrase(a, b), a="x", b="!")
    assert one(spark, T.quote_in_source(a, b), a="Le  Prix", b="voici le prix fixé") and not one(spark, T.quote_in_source(a, b), a=" ", b="x")
    assert one(spark, T.title_key(a), a="Big River (film)") == ["big", "river"] and one(spark, T.title_key(a), a="The") == []
    assert one(spark, T.domain_of(a), a="https://WWW.Example.org:80/x") == "example.org" and one(spark, T.domain_of(a), a="nothing") == ""
    assert one(spark, T.normalize_answer(a), a="The  Answer, a 'Test'!") == "answer test"
    assert one(spark, T.numbers_supported(a, b), a="about 1 299 or 4,5", b="it is 1299 and 4.5") and not one(spark, T.numbers_supported(a, b), a="7", b="8")
    assert one(spark, T.facet_key(a), a="Été  fort") == "ete-fort" and one(spark, T.facet_key(a), a=" ") == "general"


@settings(max_examples=15, deadline=None)
@given(a=st.sets(st.sampled_from("abcdef")), b=st.sets(st.sampled_from("abcdef")))
def test_jaccard(spark, a, b):
    d = spark.createDataFrame([(sorted(a), sorted(b))], "a array<string>, b array<string>")
    got = d.select(T.jaccard(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert got == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


NUMBERS = [("1 299,99", 1299.99), ("1,299.99", 1299.99), ("1.299,99", 1299.99), ("4,5", 4.5), ("16", 16.0), ("1,299", 1299.0), ("0,125", 0.125), ("1,299,000", 1299.0)]


@pytest.mark.parametrize("raw,value", NUMBERS)
def test_numbers(spark, raw, value):
    assert U.number(raw) == pytest.approx(value)
    assert one(spark, U.parse_number(F.col("t")), t=raw) == pytest.approx(value)


def test_quantities():
    found = lambda t: {(q.value, q.unit) for q in U.quantities(t) if q.unit}
    assert found("un SSD de 1 To et 16 Go de RAM") == {(1000.0, "GB"), (16.0, "GB")}
    assert found("2 semaines, 500 €, $20, 3,5 GHz") == {(14.0, "day"), (500.0, "EUR"), (20.0, "USD"), (3.5, "GHz")}
    assert found("from 2 to 5") == set() and found("30 minutes") == {(0.5, "hour")}


def test_satisfies_and_format(spark):
    d = spark.createDataFrame([(100.0, "EUR", "eq", 101.0, "EUR"), (100.0, "EUR", "le", 90.0, "EUR"), (100.0, "EUR", "ge", 1.0, "GB")], "v double, u string, c string, b double, w string")
    assert [r.x for r in d.select(U.satisfies(*[F.col(c) for c in "vucbw"]).alias("x")).collect()] == [True, False, None]
    n = spark.createDataFrame([(1299.5, "EUR"), (16.0, "GB"), (0.25, "")], "v double, u string")
    assert [r.x for r in n.select(U.format_quantity(F.col("v"), F.col("u")).alias("x")).collect()] == ["1 299,5 €", "16 Go", "0,25"]


def test_hashed_features_of_rows_that_share_an_id(spark):
    from proofsearch.operators import corpus

    texts = [(1, "Red foxes run, red foxes jump 3,5 times"), (1, "red foxes again"), (2, "the"), (3, None), (4, "écoles écoles ordinateurs")]
    d = spark.createDataFrame(texts, "document_id long, text string")
    want = {(r.document_id, r.bucket): r.w for r in corpus.weighed(corpus.counted_terms(d)).collect()}
    got = {(r.document_id, r.bucket): r.w for r in corpus.hashed_features(d).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = corpus.hashed_features(d)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
