"""Words of op9 cut at the bytes of an Arrow column against the library's pre-tokenizer; the words that a Python worker remembers."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import bpe, packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PARTS = ["'", "'s", "'re", "'l", "'ll", "'v", "'d", "'M", "s", "e", "ab", "É", "ß", "ı", "7", "½", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", "\0", ".", "¿", "-'", "日", "ʀ", "<|endoftext|>", "🙂"]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def test_words_are_those_of_the_library(monkeypatch, rng=np.random.default_rng(9)):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = len(PARTS) - 5
    texts = ["".join(PARTS[k] for k in rng.integers(0, plain if i % 9 else len(PARTS), rng.integers(0, 14))) for i in range(20_000)]
    monkeypatch.setattr(packing, "SOME", 9_000)
    got = {}
    for ids, words, off in packing._words(path, batch(["not seen", *texts, "nor that"]).slice(1, len(texts))):
        words = words.to_pylist()
        got |= {d: words[a:b] for d, a, b in zip(ids.to_pylist(), off[:-1], off[1:])}
    split = bpe.splitter(path)
    assert got == {i: split.words(t) for i, t in enumerate(texts, 1)}


def test_known_words_outlive_a_task(monkeypatch):
    path, seen, real = public_tokenizers.path("byte_bpe_50k.json"), collections.Counter(), bpe.Splitter.ids
    monkeypatch.setattr(bpe.Splitter, "ids", lambda self, w: seen.update([w]) or real(self, w))
    texts = ["known words, known\nwords", "", "words of a second task é"]

    def run(limit):
        task = packing._pieces(path, 4, 1, limit)
        return [pa.Table.from_batches(task(iter([batch(texts)]))) for _ in range(3)]

    whole = run(1000)
    assert whole[0] == whole[1] == whole[2] and set(seen.values()) == {1}
    assert run(1000) == whole and set(seen.values()) == {2}  # another job starts with none
    seen.clear()
    assert run(3) == whole and set(seen.values()) == {3}  # a table that starts anew gives the same


def test_the_library_maps_a_character_once():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        split = bpe.Splitter(public_tokenizers.path(name))
        library = split.alphabet.library
        words = [*(a + b for a in ("", " ") for b in map(chr, range(0x250))), " word", "a  b", "Ġ", " naïve", "日本", "e\u0301🙂", "<|endoftext|>"]
        want = [[split.special[w]] if w in split.special else [t.id for p, _ in library.pre_tokenize_str(w) for t in split.tok.model.tokenize(p)] for w in words]
        assert [split.ids(w) for w in words] == want
        split.alphabet.library = None
        assert [split.ids(w) for w in words] == want
