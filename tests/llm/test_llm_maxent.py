"""Size of the LM model's first factor."""

import numpy as np
import pyarrow as pa

from ledgerloom.llm import maxent, words


def test_first_factor_has_64_classes():
    assert maxent.CLASSES == 64 and maxent.Classifier().weights.shape == (2 * 2048 + 4096 + 26 * 26 + 1, 64)
    texts = [" ".join(f"w{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop")]
    t = maxent.tokens(next(words.groups(pa.array(texts, pa.string()))))
    classes = maxent.class_of(t, np.zeros(0, np.uint64))
    assert sorted(set(classes.tolist())) == list(range(39, 64))  # the end and all kinds of endings
