import math
import random

import pytest

from anchorloom.ml.search import Choices, Parzen, Range, Search

SPACE = {"x": Range(-5, 5), "k": Range(10, 300, 5, True), "s": Range(0.1, 10, 0.1), "c": ["a", "b", "c", "d"]}


def goal(t):
    return -((t["x"] - 2) ** 2) - ((t["k"] - 100) / 60) ** 2 - (t["s"] - 3) ** 2 / 4 - 2 * (t["c"] != "b")


def found(seed, trials, by_model=True, maximise=True):
    search, best = Search(SPACE, seed, maximise), -math.inf
    for _ in range(trials):
        t = search.ask() if by_model else Search(SPACE, search.rnd.random()).ask()
        best = max(best, goal(t))
        search.tell(t, goal(t) if maximise else -goal(t))
    return best, search.tried


def test_beats_random_draws():
    ours, theirs = ([found(s, 60, m)[0] for s in range(15)] for m in (True, False))
    assert sum(ours) / 15 > sum(theirs) / 15 + 0.3
    assert sum(found(s, 60, maximise=False)[0] for s in range(15)) == pytest.approx(sum(ours))


def test_values_stay_on_their_grids():
    for t, _ in found(3, 60)[1]:
        assert -5 <= t["x"] <= 5 and isinstance(t["k"], int) and t["k"] % 5 == 0 and 10 <= t["k"] <= 300
        assert 0.1 <= t["s"] <= 10 and abs(t["s"] * 10 - round(t["s"] * 10)) < 1e-9 and t["c"] in "abcd"
    odd = Range(-1, 20, 5, True)
    assert {odd.drawn(random.Random(k)) for k in range(200)} == {-1, 4, 9, 14, 19}
    assert odd.snapped(99) == 19 and odd.snapped(-99) == -1


def test_same_seed_same_settings():
    assert found(7, 30)[1] == found(7, 30)[1] != found(8, 30)[1]


def test_failed_trials_do_not_break_the_search():
    search = Search(SPACE, 1)
    for _ in range(20):
        search.tell(search.ask(), math.nan)
    assert set(search.ask()) == set(SPACE)


@pytest.mark.parametrize("seen", [[], [1.0], [1.0, 1.0, 4.9, -5.0]])
def test_densities_add_up_to_one(seen):
    n = 4000
    p = Parzen(Range(-5, 5), seen)
    assert sum(math.exp(p.log(-5 + 10 * (k + 0.5) / n)) * 10 / n for k in range(n)) == pytest.approx(1, abs=1e-3)
    grid = Parzen(Range(-5, 5, 0.5), [round(2 * s) / 2 for s in seen])
    assert sum(math.exp(grid.log(-5 + 0.5 * k)) for k in range(21)) == pytest.approx(1, abs=1e-9)
    c = Choices([1, 2, 3], [1, 1, 3])
    assert [round(math.exp(c.log(x)), 9) for x in (1, 2, 3)] == [0.5, round(1 / 6, 9), round(1 / 3, 9)]
