"""Messages of the substring operator: frequent words by their place, the others by their fingerprint."""

from __future__ import annotations

import numpy as np

from surfacelens.llm import substring


def test_messages_of_frequent_words_hold_no_fingerprints():
    texts = [" ".join(f"w{i}" for i in range(a, a + 300)).encode() for a in (0, 100)]
    sizes, late = [], []
    for known in (0, 350, 400):
        blobs = []
        for at, text in enumerate(texts):
            s = substring.Suffixes([text], 13, 1)
            s.vocabulary, codes = np.unique(s.words, return_inverse=True)
            common = substring.word_hashes([" ".join(f"w{i}" for i in range(known)).encode()])[0]
            s.places = substring._place(s.vocabulary, common)
            blobs.append(substring._message(s, s.first, codes, np.array([at])))
        sizes.append(sum(map(len, blobs)))
        late.append([x.tolist() for x in substring.Subtree(blobs, 13).late()])
    assert late[0] == late[1] == late[2] and not any(late[0][0]) and sum(late[0][1]) == 200 - 12
    assert sizes[2] + 8 * 500 < sizes[0]
