"""Random strings without digits are scored like any other long token."""

from __future__ import annotations

from ridewave.llm import secret_scan as ss
from tests.llm.fixtures import documents, passage


def test_random_letters_are_found(spark):
    ordinary = [(i, " ".join(["user_account_settings_page", "internationalization", "get_default_language_name"] * 4 + [passage(i, 30).replace(" ", "")]), "s")
                for i in range(60)]
    asked = ["zQxvKbxJwPfRqmTyBunLcHgd", "QZXKJVWPBGYQTRFXHMZDKLWQ", "internationalization_settings", "user_language_account_name"]
    df = documents(spark, ordinary + [(500 + i, t, "s") for i, t in enumerate(asked)])
    found = {r["doc_id"]: len(r["added"]) for r in ss.find_secrets(df).collect()}
    assert [found[500 + i] for i in range(4)] == [1, 1, 0, 0]


def test_ordinary_words_of_all_documents_count(spark):
    df = spark.range(2500).selectExpr("id AS doc_id", "IF(xxhash64(id) = first_value(xxhash64(id)) OVER (ORDER BY xxhash64(id) DESC), repeat('qjqjqjqj ', 1000), 'ordinary words') AS text")
    some = spark.createDataFrame([(1, "ordinary something")], "doc_id long, text string")
    ratio = lambda d: ss.markov_ratios(d).first()[0][(ss.ALPHABET.index("q") + 1) * ss.SIZE + ss.ALPHABET.index("j") + 1]
    assert ratio(df) < ratio(some) - 2
