"""Which documents the pipeline's language stage turns away: those of scripts that it hasn't learned, not short clean ones."""

from pyspark.sql import functions as F

from quarrylane.llm import language_id

STRANGE = [
    "Съешь же ещё этих мягких французских булок, да выпей чаю", "Ο γρήγορος καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί",
    "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏", "ნახე ძაღლი მინდორში და უთხარი მას რომ წავიდეს სახლში", "Да",
]


def test_unlearned_scripts_go_and_clean_documents_stay(spark, documents):
    model = language_id.train(documents, sample=300)
    own = documents.where("text rlike '[A-Za-z]'")
    strange = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(STRANGE)], "doc_id long, text string")
    rows = own.select("doc_id", "text").unionByName(strange)
    kept = language_id.keep_identified(rows, model)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in own.select("doc_id").collect()}


def test_short_clean_texts_stay(spark, documents):
    model = language_id.train(documents, sample=300)
    words = documents.where("text is not null").select("doc_id", F.substring_index(F.trim("text"), " ", 5).alias("text")).where("text rlike '[A-Za-z]'")
    n = words.count()
    assert language_id.keep_identified(words, model).count() >= 0.99 * n
