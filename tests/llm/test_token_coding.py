"""What makes op6 cheaper gives the same: spelling of words for byte-level BPE, selectors of blocks."""

import numpy as np

from stemma.llm import queries, simple8b
from stemma.llm.library_tokens import made, read


def test_spelling_of_words():
    coder = made(*read(queries.tokenizer("byte_bpe_50k.json")))
    for word in ("a", " word", "word", " ++", "#~", " é", "naïve", " 語"):
        assert coder._spelt(word) == word.encode().decode("latin-1").translate(coder.letters)
    words = [" a b", "a", " word", "\n\n", "it's", " 12", " é", "x" * 50, "!?", " !?"]
    ids, lengths = coder._encode(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == coder.whole(words)


def test_words_hold_the_most_values_that_fit():
    rng = np.random.default_rng(3)
    for n in (1, 5, 1024, 1025, 3000):
        values = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> rng.integers(0, 63, n).astype(np.uint64)
        coded = simple8b.encode(values)
        for b in range(len(coded.word_ends) - 1):
            block, at = values[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK].tolist(), 0
            for word in coded.words[coded.word_ends[b] : coded.word_ends[b + 1]].tolist():
                fit = (s for s in range(1, 15) if all(v < 1 << int(simple8b.WIDTHS[s]) for v in block[at : at + int(simple8b.COUNTS[s])]))
                assert word >> 60 == next(fit, 0)
                at += int(simple8b.COUNTS[word >> 60])
        counts = np.minimum(simple8b.BLOCK, n - np.arange(len(coded.word_ends) - 1) * simple8b.BLOCK)
        assert (simple8b.decode(coded.words, coded.escapes, coded.word_ends, counts) == values).all()
