"""Calibrated choice of senses against numpy, one use after another."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators import sense_scores as S

LEMMAS, POS = ["ir", "irse", "ver"], ["verb", "noun", "adv"]


def _unit(x):
    return x / np.linalg.norm(x)


def _make(seed):
    rng = np.random.default_rng(seed)
    vec = lambda: [float(x) for x in rng.normal(size=6)]
    menu = {w: [(s, LEMMAS[s if s < 2 and w % 2 else rng.integers(3 if w % 2 else 1)], POS[rng.integers(3)], f"t{rng.integers(3)}", vec()) for s in range(rng.integers(1 if w % 2 == 0 else 2, 7))] for w in range(8)}
    uses = [(u, int(rng.integers(9)), vec(), [None, *POS][rng.integers(4)], [None, True, False][rng.integers(3)]) for u in range(150)]
    background = [vec() for _ in range(60)]
    tokens = {}
    for u, w, *_ in uses:
        for lemma, pos in sorted({(m[1], m[2]) for m in menu.get(w, [])}):
            if rng.random() < 0.9:
                tokens[u, lemma, pos] = float(np.round(rng.normal() * 0.05, 4))
    return menu, uses, background, tokens


def _expected(menu, uses, background, tokens, nearest):
    out = {}
    base = np.stack([_unit(np.array(b)) for b in background])
    for u, w, v, pos, reflexive in uses:
        own = menu.get(w)
        if not own:
            continue
        x = np.stack([_unit(np.array(m[4])) for m in own])
        row = x @ _unit(np.array(v)) - np.sort(x @ base.T, axis=1)[:, -nearest:].mean(axis=1)
        grow = row + S.PRIOR * S.DECAY ** np.arange(len(own))
        lemmas = {m[1] for m in own}
        is_se = np.array([m[1].endswith("se") for m in own])
        gated = reflexive is not None and any(a + "se" in lemmas for a in lemmas) and bool((is_se == reflexive).any())
        if gated:
            grow = np.where(is_se == reflexive, grow, grow.min() - 1)
        keep = np.array([m[2] == pos for m in own])
        masked = pos is not None and bool(keep.any()) and not keep.all()
        if masked:
            grow = np.where(keep, grow, grow.min() - 1)
        k = int(np.argmax(grow))
        tup = [(m[1], m[2]) for m in own]
        scores = {t: tokens.get((u, *t)) for t in set(tup)}
        voted = False
        if len(scores) > 1 and None not in scores.values():
            first, second = sorted(scores.values())[::-1][:2]
            if first - second >= S.VOTE_GAP:
                voted = True
                best = max(scores, key=scores.get)
                at = [i for i, t in enumerate(tup) if t == best]
                k = at[int(np.argmax(grow[at]))]

        def gap(of, row=row, k=k):
            rest = [r for r, o in zip(row, of, strict=True) if o != of[k]]
            return max(r for r, o in zip(row, of, strict=True) if o == of[k]) - max(rest) if rest else 1.0

        out[u] = (own[k][0], gated, masked, voted, row[k], gap(tup), gap([(m[2], m[3]) for m in own]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_choice_equals_numpy(spark, seed):
    menu, uses, background, tokens = _make(seed)
    senses = spark.createDataFrame(
        [(w, *m[:1], i, *m[1:]) for w, own in menu.items() for i, m in enumerate(own)], "word int, sense int, place int, lemma string, sense_pos string, translation string, vector array<double>"
    )
    senses = S.hub_offsets(spark.createDataFrame([(b,) for b in background] * 2, "vector array<double>"), senses, nearest=7)
    rows = S.choose_senses(
        spark.createDataFrame(uses, "use int, word int, vector array<double>, pos string, reflexive boolean"), senses,
        spark.createDataFrame([(*k, v) for k, v in tokens.items()], "use int, lemma string, sense_pos string, token_score double"), F.col("sense_pos") == F.col("pos"),
    ).collect()
    want = _expected(menu, uses, background, tokens, 7)
    assert {r["use"] for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        sense, gated, masked, voted, *numbers = want[r["use"]]
        assert (r["sense"], r["gated"], r["masked"], r["voted"]) == (sense, gated, masked, voted)
        assert [r["score"], r["tuple_gap"], r["class_gap"]] == pytest.approx(numbers)
    assert all(any(w[i] for w in want.values()) for i in (1, 2, 3))


def test_hubs_without_background(spark):
    senses = spark.createDataFrame([(1, [1.0, 0.0])], "sense int, vector array<double>")
    assert S.hub_offsets(senses.limit(0), senses).first()["hub"] == 0
