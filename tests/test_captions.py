"""Caption styles per section against a walk over each clip, in blocks of a few sections."""
import random

import numpy as np
import pytest

from voxtable.functions import fixed
from voxtable.operators import automaton, decisions as D

LABELS = fixed.MENUS["caption_style"]


def walk(picks, answers, whole):
    """Per section the best lift among styles that are not the last one, and not new once four are in use."""
    full = [a or {p: 1.0} for a, p in zip(answers, picks)]
    mean = {x: sum(a.get(x, 0.0) for a in full) / len(full) for x in LABELS}
    got = []
    for k, (own, probs) in enumerate(zip(picks, full)):
        free = [x for x in LABELS if x in probs and got and x != got[-1] and (len(set(got)) < 4 or x in got)]
        score = {x: (probs[x] + fixed.LIFT_P) / (mean[x] + fixed.LIFT_MEAN) * (.5 if k > 1 and got[-2] == x else 1) for x in free}
        got.append(whole if not k else max(free, key=lambda x: (score[x], -LABELS.index(x))) if free else own)
    return got


@pytest.mark.parametrize("size", [256, 3])
def test_caption_styles(spark, size):
    r = random.Random(size)
    sections, probs, whole, want = [], [], [], {}
    for clip in range(1, 25):
        n = r.randint(1, 14)
        picks = [r.choice(LABELS) for _ in range(n)]
        answers = [None if r.random() < .15 else {x: r.random() for x in LABELS if r.random() < .8} or None for _ in range(n)]
        first = r.choice(LABELS)
        whole.append((clip, first))
        sections += [(clip, k, p) for k, p in enumerate(picks)]
        probs += [(clip, k, LABELS.index(x), v) for k, a in enumerate(answers) for x, v in (a or {}).items()]
        got = walk(picks, answers, first)
        for k, (p, g) in enumerate(zip(picks, got)):
            rule = None if not k or g == p else "same caption style as the previous section" if p == got[k - 1] else "ranked by lift over the clip's average"
            want[clip, k] = (g, rule)
    make = spark.createDataFrame
    rows = D.caption_styles(make(sections, "clip_id bigint, sec bigint, pick string"), make(probs, "clip_id bigint, sec bigint, label_ord bigint, prob double"), make(whole, "clip_id bigint, style string"), size).collect()
    assert {(x.clip_id, x.sec): (x.style, x.rule) for x in rows} == want


def test_a_clip_without_sections_has_its_global_style(spark, rows):
    none = spark.createDataFrame([], "clip_id bigint, sec bigint, start_us bigint, end_us bigint")
    styles = spark.createDataFrame([], "clip_id bigint, sec bigint, style string, rule string")
    got = D.caption_sections(none, styles, rows("clip_id bigint, style string", (3, "word_pop")), rows("clip_id bigint, duration_us bigint", (3, 9_000_000))).collect()
    assert [tuple(x) for x in got] == [(3, 0, 0, 9_000_000, "word_pop", 0)]


def test_styles_of_one_state_need_not_be_solved_for_all():
    """A section after one state costs one row, and a block's effect is that of the states one by one."""
    r = np.random.default_rng(5)
    states = D._StyleStates(len(LABELS), fixed.MAX_CAPTION_STYLES)
    n = len(states.last)
    lifts, own = r.random((6, len(LABELS))), r.integers(0, len(LABELS), 6)
    lifts[2, 1:4] = np.nan
    after = lambda k, before: states.picks(lifts[k], own[k], before)
    assert after(0, np.array([7])).shape == (1,)
    want = np.arange(n)
    for k in range(6):
        want = after(k, np.arange(n))[want]
    assert (automaton._effect(after, 6, n) == want).all()
    for s in (0, 1, 17, n - 1):
        v = np.array([s])
        for k in range(6):
            v = after(k, v)
        assert v[0] == want[s]
