"""How op2 cuts texts into pieces and looks blocks of examples up."""

import re

import numpy as np

from draftlens.llm import toxicity


def test_words_share_a_memo_whatever_stands_around_them():
    model = toxicity.Nearest([(1, "mud and clay", 1), (2, "sand", 0)])
    terms, _ = model.vector('Mud, mud. (MUD) "mud"; mud_mud—sand clay-clay')
    assert {model.names[t] for t in terms} == {"mud", "sand", "clay"}
    assert set(model.memo) == {"mud", "mud—sand", "clay"}


def test_terms_are_those_of_runs_of_letters_and_digits():
    texts = ["snake_case's 3rd-party \x1c\x85\xa0tabs\tIn", "ΟΔΟΣ ΣΣ_Σ straßenübergänge", "ไทยabc中文字 x́y", "\ud800 lone", "___", ""]
    for text in texts:
        want = []
        for run in re.findall(r"[^\W_]+", text.lower()):
            for part in re.findall(r"[฀-໿一-鿿]+|[^฀-໿一-鿿]+", run):
                spaced = not re.match(r"[฀-໿一-鿿]", part)
                want += [part, *([part[:6]] if len(part) > 6 else [])] if spaced else [part[j : j + 2] for j in range(max(1, len(part) - 1))]
        assert toxicity.terms_of(text) == want


def test_cosines_of_some_blocks_are_those_of_all():
    rng = np.random.default_rng(7)
    model = toxicity.Nearest([(i, " ".join(f"w{j}" for j in rng.integers(0, 300, 20)), int(i % 3 == 0)) for i in range(400)])
    terms, q = model.vector(" ".join(f"w{j}" for j in rng.integers(0, 320, 90)))
    whole = model.cosines(terms, q, np.arange(model.blocks))
    for blocks in ([], [5], [9, 0, 3], list(range(0, model.blocks, 2))):
        some = np.isin(np.arange(len(whole)) // toxicity.BLOCK, blocks)
        got = model.cosines(terms, q, np.array(blocks, np.int64))
        assert (got[some] == whole[some]).all()
        assert set(np.flatnonzero(got)) <= set(np.flatnonzero(whole))
