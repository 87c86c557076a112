"""Toxicity where toxic documents are rare."""

import random

from mosaiq.llm import toxicity


def test_a_marking_word_counts_however_rare_toxic_documents_are(spark):
    rng = random.Random(3)
    filler = ["".join(rng.choices("abcdefghijklm", k=7)) for _ in range(200)]
    docs, labels = [], []
    for i in range(3000):
        toxic = i % 50 == 0
        words = rng.choices(filler, k=20)
        # 0.9 of the toxic documents and 0.02 of the others: 45 to 1, but about half of the documents with it are clean.
        if rng.random() < (0.9 if toxic else 0.02):
            words.insert(rng.randrange(20), "nastyish")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.scores.get("nastyish", 0) > 2
    assert not any(f in filler for f in model.scores)
