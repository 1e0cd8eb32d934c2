"""Operator 8 looks at few places of a text for runs of one kind of character."""

import numpy as np


def test_runs_of_one_kind_are_found_by_few_places():
    from bispace.llm.token_files import ByRank

    draw = np.random.default_rng(6)
    texts = ["", "a" * 1999, "a" * 2000, " " * 2000, "b " * 4000, "x " * 333 + "\x1c" * 2000 + " y", " " * 999 + "a" * 2001, "a b" * 500 + "é" * 2500]
    texts += ["a " * int(draw.integers(0, 900)) + str(draw.choice(["q", "　", "\n"])) * int(draw.integers(1990, 2010)) + " a" * 300 for _ in range(60)]
    assert [ByRank.has_run(t) for t in texts] == [ByRank.RUN.search(t) is not None for t in texts] and not all(map(ByRank.has_run, texts))
