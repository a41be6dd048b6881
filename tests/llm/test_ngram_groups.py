"""Groups of near copies in the n-gram join: results by brute force, and how many pairs are verified."""

import numpy as np
import pytest

from lodefield.llm import ngram_join
from test_llm import check_join


def edited(rng, words: list[str], changes: int) -> list[str]:
    out = list(words)
    for at in rng.choice(len(words), changes, replace=False):
        out[at] = f"n{rng.integers(1 << 40)}"
    return out


def group(rng, name: str) -> list[str]:
    """Copies of a text that are linked with it, many that are not, a few copies of these, and some without a part of it."""
    centre = [f"{name}{i}" for i in range(64)]
    far = [edited(rng, centre, int(rng.integers(3, 6))) for _ in range(150)]
    near = [edited(rng, centre, 1) for _ in range(40)]
    copies = [edited(rng, words, 1) for words in far[:20]]
    cut = [edited(rng, centre[: 64 - k], 1) for k in range(10, 30)]
    return [" ".join(words) for words in [*far, *near, *copies, *cut, centre]]


def test_group_of_near_copies_is_not_paired_whole(spark, monkeypatch):
    seen = {}
    written = ngram_join._written

    def counted(df, name):
        out = written(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_written", counted)
    rng = np.random.default_rng(3)
    texts = group(rng, "a") + group(rng, "b")
    assert len(check_join(spark, texts)) > 100
    assert sum(seen["candidates"]) < 2 * len(texts)


@pytest.mark.parametrize("seed", [11, 12])
def test_words_that_only_the_base_has(spark, seed):
    rng = np.random.default_rng(seed)
    centre = [f"c{i}" for i in range(40)]
    wide = [f"c{i}" for i in range(34)]  # the other texts lack the end of the centre
    far = [edited(rng, wide, int(rng.integers(1, 4))) for _ in range(40)]
    texts = [centre, *far, *(edited(rng, words, 1) for words in far[:20])]
    assert check_join(spark, [" ".join(words) for words in texts])
