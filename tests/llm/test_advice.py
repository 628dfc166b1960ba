"""Places where an operator once did less than the whole job."""

import random

from tessera.llm import toxicity


def test_training_rows_that_share_words_are_no_copies(spark):
    rng, common = random.Random(5), [f"common{i}" for i in range(20)]
    texts = [" ".join(common[:10] + [f"own{i}x{j}" for j in range(30)]) for i in range(150)]
    texts += [" ".join(rng.sample(texts[i].split(), 40)) for i in range(10)]  # the same words in another order
    texts += [texts[i] + " more" for i in range(10)] + [texts[0].upper(), "", None]
    label = {i: 0 for i in range(len(texts))} | {500: 1}
    rows = spark.createDataFrame([*enumerate(texts), (500, texts[0]), (900, "unlabelled")], "doc_id long, text string")
    kept = toxicity._unlike(rows, label)
    assert set(kept) == {*range(150), 171, 500} and kept[500] == 1
