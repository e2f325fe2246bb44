"""Benchmark items whose surface changes, and items without template windows."""

import pytest

from evidentia.llm.decontaminate import contaminated

ITEM = "The Zorvan rocket flew 120 km in 45 minutes while Captain Melor watched the silver coast below and waved twice"
GERMAN = "Der alte Mann kaufte im Laden ein Brot und eine Flasche Milch für seine Frau und seine Kinder in der Straße"


def found_in(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, bench).collect()}


def test_copies_in_other_case(spark):
    got = found_in(spark, [f"see. {ITEM.upper()} end", ITEM.lower(), GERMAN.upper(), GERMAN.lower(), "of another kind altogether, with nothing in it"], [ITEM, GERMAN])
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 1)}
    assert {r["coverage"] for r in got.values()} == {1.0} and not any(r["reparameterised"] for r in got.values())


@pytest.mark.parametrize("old, new", [("Anna", "Mary Jane"), ("New York", "Paris"), ("7 meters", "9 inches")])
def test_names_and_units_of_another_length(spark, old, new):
    item = "yesterday our teacher Anna walked 7 meters from the old station in New York to see the green bridge again"
    got = found_in(spark, ["before it. " + item.replace(old, new)], [item])
    assert got[0, 0]["coverage"] == 1.0 and got[0, 0]["reparameterised"]


def test_items_of_numbers_and_names(spark):
    items = ["12 + 30 = 42, 15 + 16 = 31, 8 + 9 = 17, 100 + 1 = 101", "Present: Anna Berg, Karl Thal, Otto Feld, Ida Stein, Paul Wald, Eva Bach"]
    got = found_in(spark, [f"on the board was {x} and then it was wiped off" for x in items] + ["1 + 2 = 3 and 4 + 5 = 9 and 10 + 20 = 30 and 7 + 7 = 14"], items)
    assert set(got) == {(0, 0), (1, 1)}


def test_short_items_inside_long_documents(spark):
    items = ["What is the capital of France?", "Name three primes", "12 13", "who wrote it"]
    texts = [f"A quiz of the evening began so. {x} Nobody in the room had an answer to that" for x in items]
    changed = "A quiz of the evening began so. What is the capital of New Zealand? Nobody in the room had an answer"
    got = found_in(spark, [*texts, changed, "what is the capital", "12 people, 13 items, named three times"], items)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 0)}
    assert got[4, 0]["reparameterised"] and not got[0, 0]["reparameterised"]
