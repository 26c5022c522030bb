"""Tracking metrics in blocks against one pass over the frames."""

import numpy as np
import pandas as pd
import pytest

from barkgraph.operators import assign, mot

COLUMNS = ["frame", "id", "x", "y", "w", "h"]


def plain(truth: pd.DataFrame, guess: pd.DataFrame, threshold: float = 0.5) -> dict:
    """A sequence's statistics, frame after frame."""
    gi, pi = ({v: k for k, v in enumerate(sorted(d.id.unique()))} for d in (truth, guess))
    frames = sorted(set(truth.frame) | set(guess.frame))
    xywh = ["x", "y", "w", "h"]
    tg, pg = dict(tuple(truth.groupby("frame"))), dict(tuple(guess.groupby("frame")))
    empty = (np.empty(0, int), np.empty((0, 4)))
    data = []
    potential, gc, pc = np.zeros((len(gi), len(pi))), np.zeros(len(gi)), np.zeros(len(pi))
    together = np.zeros_like(potential)  # frames in which a pair reaches the threshold
    for f in frames:
        (g, gb), (p, pb) = (((d[f].id.map(ix).to_numpy(), d[f][xywh].to_numpy(float)) if f in d else empty) for d, ix in ((tg, gi), (pg, pi)))
        s = mot.boxes_iou(gb, pb)
        data.append((g, p, s))
        gc[g] += 1
        pc[p] += 1
        if s.size:
            share = s.sum(0)[None] + s.sum(1)[:, None] - s
            potential[g[:, None], p[None]] += np.where(share > 0, s / np.where(share > 0, share, 1), 0)
            together[g[:, None], p[None]] += s >= threshold
    n_gt, n_pred = int(gc.sum()), int(pc.sum())
    align = potential / np.maximum(1e-12, gc[:, None] + pc[None] - potential) if potential.size else potential
    k = len(mot.ALPHAS)
    tp, loc, counts = np.zeros(k), np.zeros(k), [np.zeros_like(potential) for _ in range(k)]
    clear_tp = idsw = 0
    last: dict[int, int] = {}  # the tracker id that each truth id had last
    now: dict[int, int] = {}  # and in the frame before
    for g, p, s in data:
        for i, j in assign.hungarian(-(align[g[:, None], p[None]] * s)) if s.size else []:
            hit = s[i, j] >= mot.ALPHAS - 1e-12
            tp += hit
            loc += np.where(hit, s[i, j], 0)
            for a in np.flatnonzero(hit):
                counts[a][g[i], p[j]] += 1
        held = {}
        if s.size:
            keep = np.array([[now.get(a) == b for b in p.tolist()] for a in g.tolist()])
            score = np.where(s >= threshold - 1e-12, 1000.0 * keep + s, 0.0)
            for i, j in assign.hungarian(-score):
                if score[i, j] > 0:
                    clear_tp += 1
                    a, b = int(g[i]), int(p[j])
                    idsw += a in last and last[a] != b
                    last[a] = held[a] = b
        now = held
    ng, npr = len(gi), len(pi)
    cost = np.zeros((ng + npr, ng + npr))
    cost[:ng, :npr] = gc[:, None] + pc[None] - 2 * together
    cost[:ng, npr:] = np.where(np.eye(ng, dtype=bool), gc[:, None], 1e10)
    cost[ng:, :npr] = np.where(np.eye(npr, dtype=bool), pc[None], 1e10)
    idtp = int(sum(together[i, j] for i, j in assign.hungarian(cost) if i < ng and j < npr)) if ng and npr else 0
    ass = [float((c * c / np.maximum(1, gc[:, None] + pc[None] - c)).sum()) for c in counts]
    return {
        "gt_dets": n_gt, "pred_dets": n_pred, "clear_tp": clear_tp, "fp": n_pred - clear_tp, "fn": n_gt - clear_tp, "idsw": idsw, "idtp": idtp, "idfp": n_pred - idtp, "idfn": n_gt - idtp,
        "hota_tp": tp.tolist(), "hota_fn": (n_gt - tp).tolist(), "hota_fp": (n_pred - tp).tolist(), "hota_ass": ass, "hota_loc": loc.tolist(),
    }


def walk(rng, frames, ids, jitter, change=0):
    """Boxes that wander beside each other and now and then overlap; ids change every so many frames."""
    rows = []
    for f in range(frames):
        for i in range(ids):
            if rng.random() < 0.8:
                x, y = i * 25 + 3 * np.sin(f / 5 + i) + rng.normal(0, jitter, 2)
                rows.append((f, i + (f // change * 7 if change else 0), x, y, 30.0, 30.0))
    return pd.DataFrame(rows, columns=COLUMNS)


def same(a, b):
    assert set(a) <= set(b)
    for c in a:
        assert np.allclose(a[c], b[c]), c


@pytest.mark.parametrize("seed", range(8))
def test_one_block_as_one_pass(seed):
    rng = np.random.default_rng(seed)
    truth, guess = walk(rng, 40, 5, 1), walk(rng, 40, 6, 6, 13)
    same(plain(truth, guess), mot.sequence_stats(truth, guess))


@pytest.mark.parametrize("block", [16, 4096])
def test_blocks_as_one_pass(spark, monkeypatch, block):
    monkeypatch.setattr(mot, "BLOCK", block)
    rng = np.random.default_rng(3)
    truth = pd.concat([walk(rng, 500, 5, 1).assign(sequence=1), walk(rng, 60, 2, 1).assign(sequence=2), walk(rng, 20, 2, 1).assign(sequence=3)])
    guess = pd.concat([walk(rng, 500, 6, 6, 90).assign(sequence=1), walk(rng, 80, 2, 2).assign(sequence=2), walk(rng, 20, 2, 1).assign(sequence=4)])
    got = mot.statistics(spark.createDataFrame(truth), spark.createDataFrame(guess)).toPandas().set_index("sequence")
    for s in (1, 2, 3, 4):
        same(plain(truth[truth.sequence == s], guess[guess.sequence == s]), dict(got.loc[s]))


def test_an_id_twice_in_a_frame_fails_its_sequence_alone(spark):
    rng = np.random.default_rng(4)
    truth = walk(rng, 50, 3, 1)
    whole = pd.concat([truth.assign(sequence=1), truth.assign(sequence=2), truth.head(1).assign(sequence=2)])
    guess = pd.concat([truth.assign(sequence=s) for s in (1, 2)])
    got = mot.statistics(spark.createDataFrame(whole), spark.createDataFrame(guess), isolate=True).toPandas().set_index("sequence")
    same(plain(truth, truth), dict(got.loc[1]))
    assert got.loc[1].error is None and (got.loc[2].error, got.loc[2].details) == ("ValueError", "an id twice in a frame")
