"""The overlay rules walked shot by shot over one clip, to compare the distributed planner with."""
import numpy as np
import pandas as pd

from voxtable.functions import fixed


def _spread_best_first(start, rank, ok, taken, gap, most=None):
    """Indices accepted in rank order, each at least ``gap`` from all accepted before it."""
    got, times = [], list(taken)
    for i in rank:
        if most is not None and len(got) >= most:
            break
        if ok[i] and all(abs(t - start[i]) >= gap for t in times):
            got.append(int(i))
            times.append(start[i])
    return got


def plan(pdf: pd.DataFrame, cap=fixed.COVERAGE_CAP, max_dead_us=fixed.DEAD_RUN_US, allow_giants=True) -> pd.DataFrame:
    pdf = pdf.sort_values("unit").reset_index(drop=True)
    n = len(pdf)
    start, end = pdf["start_us"].to_numpy(), pdf["end_us"].to_numpy()
    hook_us, total = int(pdf["hook_end_us"].iloc[0]), int(pdf["duration_us"].iloc[0])
    now, log = pdf["overlay"].tolist(), [[] for _ in range(n)]
    word, p_giant, graphic = pdf["giant_word"].tolist(), pdf["p_giant"].to_numpy(), pdf["graphic"].to_numpy()
    others = pdf[["p_none", "p_card", "p_pill"]].to_numpy()

    def change(i, rule, to):
        log[i].append(f"{rule}: {now[i]} -> {to}")
        now[i] = to
    for i in range(n):
        if hook_us > 0 and start[i] < hook_us - 200_000 and now[i] != "none":
            change(i, "hook window stays clean", "none")
    ranked = sorted(range(n), key=lambda i: (-p_giant[i], i))
    late = start >= hook_us + fixed.GIANT_AFTER_HOOK_US
    has = np.array([isinstance(w, str) for w in word])
    asked = [i for i in ranked if now[i] == "giant_word"]
    giants = _spread_best_first(start, asked, late & has & allow_giants, [], fixed.GIANT_GAP_US)
    for i in asked:
        if i in giants:
            continue
        ahead = [g for g in giants if (-p_giant[g], g) < (-p_giant[i], i)]
        if not allow_giants:
            why = "no reliable face for a cut-out"
        elif not late[i]:
            why = "giant word too close to the hook"
        elif any(abs(start[g] - start[i]) < fixed.GIANT_GAP_US for g in ahead):
            why = "giant words at least 8.5 s apart"
        else:
            why = "no plain word of 3 to 12 letters in this shot"
        change(i, why, ["none", "card", "keyword_pill"][int(np.argmax(others[i]))])
    wanted = (total - hook_us) // fixed.GIANT_EVERY_US if allow_giants else 0
    if len(giants) < wanted:
        more = _spread_best_first(start, [i for i in ranked if i not in giants], late & has, [start[g] for g in giants],
                                  fixed.GIANT_GAP_US, wanted - len(giants))
        for i in more:
            change(i, f"no giant word in the first {int(start[i] / 1e6 + 0.5)} s of a {int(total / 1e6 + 0.5)} s clip: best supported shot promoted", "giant_word")
        giants += more
    # cards: the least wanted go first; losing one may not open a bare stretch over the limit
    bare = np.array([o == "none" for o in now])
    card = np.array([o in ("card", "keyword_pill") for o in now])
    shown = int((end - start)[card].sum())
    room = max(1_000_000, total - hook_us)
    for i in sorted(np.flatnonzero(card), key=lambda i: (graphic[i], i)):
        if shown / room <= cap:
            break
        a, b = i, i
        while a > 0 and bare[a - 1]:
            a -= 1
        while b + 1 < n and bare[b + 1]:
            b += 1
        if end[b] - start[a] <= max_dead_us:
            change(i, f"card density cap ({int(cap * 100 + 0.5)}% of the speaking time)", "none")
            bare[i] = True
            shown -= int(end[i] - start[i])
    keep = set(giants)
    return pd.DataFrame({"clip_id": pdf["clip_id"], "unit": pdf["unit"], "overlay": now,
                         "giant": [word[i] if i in keep else None for i in range(n)], "log": log})
