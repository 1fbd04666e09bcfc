"""Stems against published examples, in the engine and in plain SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstack.functions import stems

#: Examples of the paper that describes the English steps, and forms of irregular verbs.
ENGLISH = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic
formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular
homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil by by yellow yellow
stolen steal stole steal went go took take written write""".split()
#: Forms that are to meet.
TOGETHER = {
    "ru": ["дракон драконы драконов дракону драконами", "красный красного красные", "ёлка елки"],
    "de": ["Haus Hauses Häuser Häusern", "Kind Kinder Kindern Kindes", "Straße Straßen"],
    "fr": ["cheval chevaux", "petit petite petits petites", "gâteau gâteaux"],
    "es": ["gato gatos gata gatas", "luz luces", "canción canciones"],
}


def engine(spark, words):
    df = spark.createDataFrame(words, "word string, lang string")
    return [r.s for r in df.select(stems.stem("word", "lang").alias("s")).collect()]


@pytest.mark.parametrize("where", ["engine", "plain"])
def test_published_examples(spark, duck, where):
    words = ENGLISH[::2]
    if where == "engine":
        got = engine(spark, [(w, "en") for w in words])
    else:
        got = [duck.sql(f"select {stems.stem_sql(stems.PLAIN, repr(w), 'en')}").fetchall()[0][0] for w in words]
    assert list(zip(words, got, strict=True)) == list(zip(words, ENGLISH[1::2], strict=True))


@pytest.mark.parametrize("language", sorted(TOGETHER))
def test_forms_meet(spark, language):
    for line in TOGETHER[language]:
        assert len(set(engine(spark, [(w.lower(), language) for w in line.split()]))) == 1, line


def test_odd_words(spark):
    got = engine(spark, [("", "en"), ("s", "en"), ("y", "xx"), (None, "en"), ("ed", None), ("é", "fr"), ("a" * 5000, "de")])
    assert got[:6] == ["", "s", "y", None, "ed", "e"] and len(got[6]) == 5000
    own = spark.createDataFrame([("drakes",)], "word string").select(F.expr(stems.stem_sql(stems.ENGINE, "word", "en", {"duck": "drakes"})).alias("s"))
    assert own.first().s == "duck"
