"""What a worker remembers of the parts of texts."""

import numpy as np
import pytest

from draftlens.llm import packing

pytest.importorskip("tokenizers")


def test_a_frequent_part_outlasts_a_full_memo(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 4)
    parts = packing._Parts(packing.public_tokenizer())
    asked = []
    real = parts.pieces
    monkeypatch.setattr(parts, "pieces", lambda text: asked.append(text) or real(text), raising=False)
    for i in range(40):
        for part in ("Frequent,", f"rare{i}"):
            assert list(np.frombuffer(parts[part], "<u4")) == parts.whole.encode(part, add_special_tokens=False).ids
    assert asked.count("frequent,") == 1 and len(parts) <= 4 and len(parts.words) <= 4


def test_a_long_part_is_not_remembered(monkeypatch):
    parts = packing._Parts(packing.public_tokenizer())
    long = "word" * 5000
    assert list(np.frombuffer(parts[long], "<u4")) == parts.whole.encode(long, add_special_tokens=False).ids
    assert long not in parts and long not in parts.words
