from __future__ import annotations

import numpy as np
import pyarrow as pa

from llm_corpus import alnum_words, corpus, words  # noqa: F401
from decoyscope.llm.textkit import ALNUM, NON_SPACE, chunks, windows


def _found(texts, table, fold, limit):
    seen = []
    for chunk in chunks(pa.array(texts, pa.string()), limit):
        starts, ends, counts = chunk.words(table)
        data, at = chunk.data.tobytes(), 0
        for count in counts:
            seen.append([data[s:e].decode() for s, e in zip(starts[at : at + count], ends[at : at + count])])
            at += count
    return seen


def test_words_are_those_of_the_pattern_at_any_chunk_size(corpus):
    texts = [text for _, text, _, _ in corpus]
    for limit in (1, 50, 1 << 20):
        assert [[w.lower() for w in ws] for ws in _found(texts, NON_SPACE, True, limit)] == [[w.lower() for w in words(t)] for t in texts]
        assert [[w.lower() for w in ws] for ws in _found(texts, ALNUM, True, limit)] == [[w.lower() for w in alnum_words(t)] for t in texts]


def test_hashes_name_words_and_windows(corpus):
    texts = [text for _, text, _, _ in corpus]
    by_hash, by_window = {}, {}
    for chunk in chunks(pa.array(texts, pa.string()), 4000):
        starts, ends, counts = chunk.words(NON_SPACE)
        hashes = chunk.hasher(fold=True)(starts, ends)
        text = [w for k in range(len(chunk)) for w in words(texts[chunk.first + k])]
        for word, value in zip(text, hashes.tolist()):
            assert by_hash.setdefault(value, word) == word
        grams, number = windows(hashes, counts, 3)
        at = first = 0
        for count, n in zip(counts, number):
            for k in range(n):
                assert by_window.setdefault(int(grams[first + k]), text[at + k : at + k + 3]) == text[at + k : at + k + 3]
            at, first = at + count, first + n
    assert len(set(by_hash.values())) == len(by_hash)
    assert len({tuple(w) for w in by_window.values()}) == len(by_window)


def test_code_points_and_no_texts():
    (chunk,) = chunks(pa.array(["aé日🙂", None, "b"]))
    assert np.diff(chunk.code_points()[chunk.offsets]).tolist() == [4, 0, 1]
    assert list(chunks(pa.array([], pa.string()))) == []
    assert list(chunks(pa.chunked_array([], pa.string()))) == []
