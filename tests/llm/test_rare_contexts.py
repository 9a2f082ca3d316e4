"""Every context of the learning sample counts, however rare."""

import numpy as np
import pandas as pd

from hazemeter.llm import langid


def test_rare_contexts_stay():
    learned = {"x": "ab", "y": "cb"}
    counts = pd.DataFrame(
        [(i, k, int.from_bytes(t[at - k : at + 1].encode(), "little")) for i, t in enumerate(learned.values()) for at in range(2) for k in range(at + 1)],
        columns=["lang", "ctx", "gram"],
    ).value_counts().reset_index()
    trees = langid.Trees(list(learned), *(counts[c].to_numpy() for c in ("lang", "ctx", "gram", "count")))
    # x: 1/4 for "a", then 1/2 for "b" after "a". y: two of four for the escape, 254 bytes left; then 1/4 for "b", "a" being unknown.
    np.testing.assert_allclose(trees.lengths([b"ab"]), [[2 + 1, 1 + np.log2(254) + 2]], rtol=1e-6)
