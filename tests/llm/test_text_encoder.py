"""Ids by the table of remembered pieces against the untouched library."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from kgspark.llm import token_output

PARTS = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\u0085", "x", "Word", "é", "漢", "1", "23", "'s", "'ll", "'", ".", ",", "!?", "\0", "\x1c", "\u200b", "<|endoftext|>", "-", "ß", "\r\n", "\x0b", "²", "a" * 20, "(", "don't", "café"]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("places", [1 << 20, 16])
def test_ids_are_those_of_the_library(monkeypatch, seed, places):
    monkeypatch.setattr(token_output, "PLACES", places)
    monkeypatch.setattr(token_output, "CHUNK_BYTES", 2000)
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS[: rng.randint(3, len(PARTS))] if rng.random() < 0.5 else PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    plain = Tokenizer.from_file(token_output.tokenizer_path())
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    encode = token_output.TextEncoder(token_output.tokenizer_path())
    for part in (texts[:1500], [], texts[:1500], texts):
        ids, lengths = encode([t.encode() for t in part])
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths))[:-1]] == want[: len(part)]
