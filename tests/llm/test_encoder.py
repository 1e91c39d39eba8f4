"""The encoder of op6 against the tokenizer itself, over batches that share words and pieces."""

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sablefin.llm import packing


@pytest.mark.parametrize("most", [3, 1000])
def test_encoder(monkeypatch, most):
    """A word that is also another's piece counts once."""
    monkeypatch.setattr(packing, "CACHE_WORDS", most)
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    batches = [["abc!!! !!! -- word--", ""], ["zeta gamma, delta?", "the word -- it's"], ["more the words; here Ünï 日本", "word-- again the"], ["the last the word"]]
    for texts in batches * 2:
        got = [ids[:-1].tolist() for ids in encoder.batch(pa.array(texts, pa.large_string()))]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
