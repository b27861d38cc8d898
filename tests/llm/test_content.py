"""Content scores: foldings, phrases, exceptions, agreement with reviewers, odd texts."""

import pytest
from pyspark.sql import functions as F

from sitewise.llm import content_score as cs
from sitewise.llm.content_queries import QUERIES
from sitewise.session import table

S = cs.Scorer()
ABUSIVE = [
    "You are a bastard.", "you B.A.S.T.A.R.D", "what a b a s t a r d", "b*****d!", "ｂａｓｔａｒｄ", "bаstаrd", "b4st4rd", "bastrad", "baaaaastard", "ba​st​ard", "the nurse is a pathetic, stinking pig", "go to hell u spineless m4gg0+",
    "I hope you choke on your own spit", "Typical, foreigners breed like rats", "I know where you live and I will break your legs", "send me nudes", "du dumme Schlampe", "Espèce d'abruti", "hijo de puta", "ты идиот", "είσαι μαλάκας", "你这个白痴医生，去死吧。", "白 痴", "f u c k you", "fu%k you",
]
HARMLESS = [
    "", "   ", "Skin prick test negative, cockroach allergy positive.", "Growth retardation in utero, spastic gait, idiopathic cause.", "I am furious about my bill, this is not acceptable.", "Is it safe to have sex again after heart surgery?", "Sexual assault kit sealed; verbally abusive during the night.", "Feels worthless at times, felt stupid for missing the visit.",
    "The wound smells like rotten fish, bitten by a dog.", "assess anal fissure, assign class 3, pass on", "Sucking chest wound teaching", "The dose was stupidly hard to read", "C A V E: allergy", "U R G E N T: call", "Die Pflege war freundlich.", "护士很耐心，谢谢。", "** ple@se c@ll the nurse", "hit by a car, fat embolism excluded", "node017 12:30 <5 mg/dl", "-----***-----",
]


@pytest.mark.parametrize("text", ABUSIVE)
def test_cases(text):
    assert S.score(text)[2], S.folder.fold(text)


@pytest.mark.parametrize("text", HARMLESS)
def test_no_cases(text):
    assert not S.score(text)[2], S.score(text)


def test_score_is_normalised_by_length():
    short, long = S.score("You are a bastard."), S.score("You are a bastard. " + "The scan was clear. " * 500)
    assert short[2] and long[2] and long[0] < short[0] / 20


def test_very_long_and_odd_texts():
    assert not S.score("x" * 300_000)[2]
    assert S.score("word " * 100_000 + "you bastard")[2]
    assert S.score(None) == (0.0, 0.0, False, 0, [])


@pytest.mark.parametrize("text", ["f" + "." * 40 + "u.c.k.e.r", "s111111ut", "s" + "1" * 60 + "ut", "<b>1diot</b>", "you/1diot", "k1ll y0urself", "x" * 30 + "!" * 30 + "b4st4rd", "#" * 300 + " you bastard", "http://" + "a/" * 200 + "wh0re", "I swear I will break your legs", "no bed for refugees, send them home"])
def test_no_cut_hides_a_word(text):
    assert S.score(text)[2], S.folder.fold(text)


@pytest.mark.parametrize("text", ["I will break the news to your children gently", "Thank you all, I will go to a lawyer", "I would cut the dressing for the nurse", "no bed for the new patient", "the dog bite on his hand, hit by a car", "you have a brain scan, no brain metastases"])
def test_parts_alone_are_no_case(text):
    assert not S.score(text)[2], S.score(text)


def test_chinese_counts_by_its_signs():
    many, one = S.score("白痴" * 50), S.score("白痴" + "护士很耐心" * 50)
    assert many[2] and one[2] and many[0] > 20 * one[0] and one[3] > 200


def test_recall_and_precision_where_two_reviewers_agree(spark):
    """Where two reviewers agree, as single ones err. The labels were not read, but texts of this table were when entries were written: no held-out figure."""
    sf = "/root/testdata/check_l"
    labels = table(spark, sf, "review_labels").groupBy("doc_id").agg(F.avg("abusive").alias("a"), F.count("*").alias("k")).where("k > 1 and a in (0.0, 1.0)")
    texts = table(spark, sf, "documents").join(labels, "doc_id")
    n = {(r.a, r.is_case): r["count"] for r in cs.score_texts(texts, ["doc_id", "a"], "text").groupBy("a", "is_case").count().collect()}
    hit, missed, wrong = (n.get(k, 0) for k in ((1.0, True), (1.0, False), (0.0, True)))
    assert hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.95


def test_tables(spark, small):
    df = spark.createDataFrame([(1, "you bastard", "s", 3.0), (1, "you bastard", "s", 3.0), (2, None, None, None)], "doc_id long, text string, source string, note double")
    got = cs.score_texts(df, ["doc_id", "source"], "text")
    assert sorted((r.doc_id, r.is_case) for r in got.collect()) == [(1, True), (1, True), (2, False)]
    rates = {r.source: r.case_rate for r in cs.rates(got, "source").collect()}
    assert rates == {"s": 1.0, None: 0.0}
    assert cs.score_texts(df.limit(0), ["doc_id"], "text").count() == 0
    assert QUERIES["p8_found"](spark, small).columns == ["doc_id"]
