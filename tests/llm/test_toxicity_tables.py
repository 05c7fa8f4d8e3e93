from __future__ import annotations

import random

import numpy as np

from tallyforge.llm import toxicity


def test_every_ngram_has_its_own_value(spark):
    """Tens of thousands of n-grams, of which a table of fixed size lost those that shared a slot."""
    rng = random.Random(3)
    rows = [(" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(400)), i % 2) for i in range(30)]
    frame = spark.createDataFrame(rows, "text string, toxic int")
    grams = [r["gram"] for r in toxicity.gram_counts(frame).collect()]
    model = toxicity.fit_language_models(frame)
    for n, own, table in ((toxicity.ORDER, grams, model.grams), (toxicity.ORDER - 1, sorted({g[:-1] for g in grams}), model.contexts)):
        keys = toxicity.keys_of(np.frombuffer("".join(own).encode("utf-32-le"), "<u4"), n)[::n]
        hit, _ = table.look(keys)
        assert hit.all() and len(table.key) == len(own) == len(np.unique(table.key))
        assert not table.look(keys + np.uint64(1))[0].any()
