"""Tree models of many short series at once: a bootstrapped forest with exact splits, and leaf-wise boosting on histograms.

A series has few rows, so a model of its own is cheap; what costs is the number of steps. The forest therefore grows all trees of a
series level by level in one array, over columns sorted once, and boosting grows the trees of many series and folds side by side, one leaf
of each per step, with the histogram of the smaller child taken from its rows and that of its sibling by subtraction.

Ties are decided alike everywhere: among splits whose gains differ by less than a billionth of the node's sum of squares, the first feature
and then the smallest threshold wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TIE = 1e-9
LEAST = 20  # rows of a leaf in boosting
BINS = 255
CELLS = 4_000_000  # histogram cells, or sorted cells, that one step works on at most


# ------------------------------------------------------------------ forest


def bootstrap(rows: int, trees: int, seed: int) -> np.ndarray:
    """How often each tree draws each row, trees x rows; depends on nothing but these numbers."""
    drawn = np.random.default_rng([seed, rows]).integers(0, rows, (trees, rows))
    flat = np.bincount((np.arange(trees)[:, None] * rows + drawn).ravel(), minlength=trees * rows)
    return flat.reshape(trees, rows)


@dataclass
class Forest:
    """Complete binary trees by level; node k has the children 2k and 2k+1, the root is 1. A leaf has feature -1."""

    feature: np.ndarray  # trees x nodes
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def cut(self, depth: int) -> Forest:
        """The same trees grown to a smaller depth: a split depends on nothing below it."""
        return Forest(self.feature, self.threshold, self.value, min(depth, self.depth))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over trees for every row of x."""
        trees = np.arange(len(self.feature))[:, None]
        node = np.ones((len(self.feature), len(x)), int)
        rows = np.arange(len(x))[None, :]
        for _ in range(self.depth):
            feature = self.feature[trees, node]
            right = x[rows, np.maximum(feature, 0)] > self.threshold[trees, node]
            node = np.where(feature < 0, node, 2 * node + right)
        return self.value[trees, node].mean(0)


def grow_forest(x: np.ndarray, y: np.ndarray, weights: np.ndarray, depth: int) -> Forest:
    """Regression trees of least squares on weighted rows (weights: trees x rows; rows of weight 0 do not exist for a tree)."""
    rows, features = x.shape
    step = max(1, CELLS // (rows * features))
    centre = y.mean()  # so that sums of squares measure the spread
    parts = [_grow_trees(x, y - centre, weights[a : a + step], depth) for a in range(0, len(weights), step)]
    feature, threshold, value = (np.concatenate([getattr(p, f) for p in parts]) for f in ("feature", "threshold", "value"))
    return Forest(feature, threshold, value + centre, depth)


def _grow_trees(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> Forest:
    """An entry is a row that a tree drew. Every column holds the entries ordered by node and value; nodes that cannot be split leave."""
    (trees, rows), features = w.shape, x.shape[1]
    nodes = 1 << (depth + 1)
    feature = np.full((trees, nodes), -1)
    threshold, value = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    drawn = w > 0
    tree_of, row_of = np.nonzero(drawn)
    weight = w[drawn].astype(float)
    wy, wyy = weight * y[row_of], weight * y[row_of] ** 2
    order = np.argsort(x, axis=0, kind="stable").T
    number = (np.cumsum(drawn.ravel()) - 1).astype(np.int32).reshape(trees, rows)
    entries = number[:, order].transpose(1, 0, 2)[drawn[:, order].transpose(1, 0, 2)].reshape(features, -1)
    tied = np.flatnonzero((np.diff(np.sort(x, axis=0), axis=0) == 0).any(axis=0))  # columns in which values repeat
    tied_values = x.T[tied][:, row_of]
    node_tree, node_id, counts = np.arange(trees), np.ones(trees, int), drawn.sum(1)
    starts = np.cumsum(counts) - counts
    value[:, 1] = np.add.reduceat(wy, starts) / np.add.reduceat(weight, starts)
    for level in range(depth):
        size, ends = entries.shape[1], starts + counts - 1
        heavy, summed, squares = (np.add.reduceat(c[entries[0]], starts) for c in (weight, wy, wyy))
        noise = TIE * squares
        # Sums left of every place of every column, within its node; the gain of a cut there, divided by the node's weight.
        left_w = np.cumsum(weight[entries], axis=1)
        left_w -= np.repeat(np.cumsum(heavy) - heavy, counts)
        left_s = np.cumsum(wy[entries], axis=1)
        left_s -= np.repeat(np.cumsum(summed) - summed, counts)
        gain = left_s - left_w * np.repeat(summed / heavy, counts)
        gain *= gain
        both = np.repeat(heavy, counts) - left_w
        both *= left_w
        both[:, ends] = 1.0
        gain /= both
        gain[:, ends] = -np.inf
        if len(tied):
            held = np.take_along_axis(tied_values, entries[tied], axis=1)
            same = np.zeros(held.shape, bool)
            same[:, :-1] = held[:, 1:] == held[:, :-1]
            gain[tied] = np.where(same, -np.inf, gain[tied])
        by_feature = np.maximum.reduceat(gain, starts, axis=1)
        best = by_feature.max(0)
        least = best - noise / heavy
        chosen = (by_feature >= least).argmax(0)
        splits = np.flatnonzero(best * heavy > noise)
        if not len(splits):
            break
        place, picked = np.arange(size), np.repeat(chosen, counts)
        first = np.where(gain[picked, place] >= np.repeat(least, counts), place, size)
        at = np.minimum.reduceat(first, starts)
        t, k, f, cut_at = node_tree[splits], node_id[splits], chosen[splits], at[splits]
        feature[t, k] = f
        threshold[t, k] = (x[row_of[entries[f, cut_at]], f] + x[row_of[entries[f, cut_at + 1]], f]) / 2
        value[t, 2 * k] = left_s[f, cut_at] / left_w[f, cut_at]
        value[t, 2 * k + 1] = (summed[splits] - left_s[f, cut_at]) / (heavy[splits] - left_w[f, cut_at])
        if level + 1 == depth:
            break

        # Children of two rows or more go on, in the order of their parents.
        left = cut_at - starts[splits] + 1
        sizes = np.column_stack([left, counts[splits] - left]).ravel()
        alive = sizes > 1
        kept = int(alive.sum())
        if not kept:
            break
        child = np.full((len(counts), 2), kept)
        child[splits] = np.where(alive, np.cumsum(alive) - 1, kept).reshape(-1, 2)
        key = np.empty(len(weight), np.uint16 if kept < 65535 else np.int64)
        right = place > np.repeat(at, counts)
        key[entries[picked, place]] = child[np.repeat(np.arange(len(counts)), counts), right.astype(int)]
        counts = sizes[alive]
        starts = np.cumsum(counts) - counts
        moved = np.argsort(key[entries], axis=1, kind="stable")[:, : int(counts.sum())]
        entries = np.take_along_axis(entries, moved, axis=1)
        node_tree, node_id = np.repeat(t, 2)[alive], np.column_stack([2 * k, 2 * k + 1]).ravel()[alive]
    return Forest(feature, threshold, value, depth)


# ------------------------------------------------------------------ boosting


@dataclass
class Boosting:
    """Trees as lists of splits: split s sends the rows of leaf `leaf` beyond the threshold to the new leaf s+1. jobs x rounds x splits."""

    start: np.ndarray  # jobs
    leaf: np.ndarray  # -1: no split
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray  # jobs x rounds x leaves

    def predict(self, x: np.ndarray) -> np.ndarray:
        """One prediction per row of each job; x: jobs x rows x features."""
        jobs, rows, _ = x.shape
        rounds = self.leaf.shape[1]
        at = np.zeros((jobs, rounds, rows), np.int16)
        j = np.arange(jobs)[:, None, None]
        for s in range(self.leaf.shape[2]):
            right = x[j, np.arange(rows), self.feature[:, :, s][:, :, None]] > self.threshold[:, :, s][:, :, None]
            at = np.where(right & (at == self.leaf[:, :, s][:, :, None]), s + 1, at)
        return self.start[:, None] + np.take_along_axis(self.value, at.astype(int), axis=2).sum(1)


def bin_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between the distinct values, or between their quantiles if there are more than bins."""
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[:-1] + distinct[1:]) / 2
    return np.unique(np.percentile(values, np.linspace(0, 100, bins + 1)[1:-1], method="midpoint"))


def possible_leaves(rows: int, leaves: int, least: int = LEAST) -> int:
    """Leaves that a tree on so many rows can have at most, as none has fewer than `least`."""
    return max(1, min(leaves, rows // least))


def boost(xs: list[np.ndarray], ys: list[np.ndarray], leaves: list[int], rounds: int = 100, rate: float = 0.1, least: int = LEAST, bins: int = BINS) -> Boosting:
    """Least squares boosting of every job (its rows, targets and number of leaves) side by side.

    A leaf is split only into parts of `least` rows or more; the leaf of the largest gain is split first.
    """
    features, longest = xs[0].shape[1], max(len(y) for y in ys)
    most = max(2, possible_leaves(longest, max(leaves), least))
    grows = [k for k, (y, n) in enumerate(zip(ys, leaves)) if possible_leaves(len(y), n, least) > 1]
    if len(grows) < len(xs):  # a job that can split nothing predicts its mean
        shape = (len(xs), rounds, most - 1)
        out = Boosting(np.array([y.mean() for y in ys]), np.full(shape, -1, np.int16), np.zeros(shape, np.int32), np.full(shape, np.inf), np.zeros((len(xs), rounds, most)))
        if grows:
            grown = boost([xs[k] for k in grows], [ys[k] for k in grows], [leaves[k] for k in grows], rounds, rate, least, bins)
            for f in ("start", "leaf", "feature", "threshold", "value"):
                getattr(out, f)[grows] = getattr(grown, f)
        return out
    step = max(1, CELLS // (features * max(most * min(bins, longest), longest)))
    parts = [_boost(xs[a : a + step], ys[a : a + step], np.array(leaves[a : a + step]), most, rounds, rate, least, bins) for a in range(0, len(xs), step)]
    return Boosting(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("start", "leaf", "feature", "threshold", "value")))


def _boost(xs, ys, leaves, most, rounds, rate, least, bins) -> Boosting:
    jobs, features, rows = len(xs), xs[0].shape[1], max(len(y) for y in ys)
    edges = [[bin_edges(x[:, f], bins) for f in range(features)] for x in xs]
    width = max(len(e) for job in edges for e in job) + 1
    codes = np.zeros((jobs, features, rows), np.int32)
    held, y = np.zeros((jobs, rows), bool), np.zeros((jobs, rows))
    cuts = np.full((jobs, features, width), np.inf)
    for j, (x, target) in enumerate(zip(xs, ys)):
        held[j, : len(target)], y[j, : len(target)] = True, target
        for f in range(features):
            cuts[j, f, : len(edges[j][f])] = edges[j][f]
            codes[j, f, : len(target)] = np.searchsorted(edges[j][f], x[:, f], "left")
    cell = codes + (np.arange(features) * width)[None, :, None]
    start = y.sum(1) / held.sum(1)
    guess = np.where(held, start[:, None], 0.0)
    shape = (jobs, rounds, most - 1)
    out = Boosting(start, np.full(shape, -1, np.int16), np.zeros(shape, np.int32), np.full(shape, np.inf), np.zeros((jobs, rounds, most)))

    cells = features * width
    index = cell.reshape(jobs, -1) + (np.arange(jobs) * cells)[:, None]

    def histogram(which: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums of the rows' weights by feature and bin, for some jobs."""
        own = index if len(which) == jobs else cell.reshape(jobs, -1)[which] + (np.arange(len(which)) * cells)[:, None]
        return np.bincount(own.ravel(), np.tile(weights, features).ravel(), len(which) * cells).reshape(-1, features, width)

    def best_split(count: np.ndarray, total: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gain, feature and bin of the best split of each leaf; squares: its sum of squared residuals."""
        n, s = np.cumsum(count, axis=2), np.cumsum(total, axis=2)
        whole, summed = n[:, :1, -1:].copy(), s[:, :, -1:].copy()
        rest = whole - n
        good = (np.minimum(n, rest) >= least) & (count > 0)
        s -= n * (summed / np.maximum(whole, 1))
        s *= s
        n *= rest
        s *= whole
        s /= np.where(good, n, 1.0)
        gain = np.where(good, s, -np.inf).reshape(len(count), -1)
        noise = TIE * squares
        best = gain.max(1)
        at = (gain >= (best - noise)[:, None]).argmax(1)
        return np.where(best > noise, best, -np.inf), at // width, at % width

    every = np.arange(jobs)
    rows_of_bin = histogram(every, held)
    for r in range(rounds):
        residual = np.where(held, y - guess, 0.0)
        leaf = np.where(held, 0, -1).astype(np.int16)
        count, total = np.empty((jobs, most, features, width)), np.empty((jobs, most, features, width))
        count[:, 0], total[:, 0] = rows_of_bin, histogram(every, residual)
        gain = np.full((jobs, most), -np.inf)
        feature, cut = np.zeros((jobs, most), int), np.zeros((jobs, most), int)
        gain[:, 0], feature[:, 0], cut[:, 0] = best_split(count[:, 0], total[:, 0], (residual**2).sum(1))
        for s in range(most - 1):
            pick = gain.argmax(1)
            own = np.flatnonzero((gain[every, pick] > 0) & (s + 1 < leaves))
            if not len(own):
                break
            old, f, b = pick[own], feature[own, pick[own]], cut[own, pick[own]]
            out.leaf[own, r, s], out.feature[own, r, s], out.threshold[own, r, s] = old, f, cuts[own, f, b]
            inside = leaf[own] == old[:, None]
            right = inside & (codes[own, f] > b[:, None])
            leaf[own] = np.where(right, s + 1, leaf[own])
            left = inside & ~right
            small = np.where((right.sum(1) < left.sum(1))[:, None], right, left)
            gain[own, old] = gain[own, s + 1] = -np.inf
            # Only a leaf of twice the least rows can be split again, and only while its tree may have more leaves.
            n_left, n_right = left.sum(1), right.sum(1)
            more = np.flatnonzero((np.maximum(n_left, n_right) >= 2 * least) & (s + 2 < leaves[own]))
            if not len(more):
                continue
            own, old, left, right, small, n_left, n_right = (v[more] for v in (own, old, left, right, small, n_left, n_right))
            n, t = histogram(own, small), histogram(own, np.where(small, residual[own], 0.0))
            is_right = (n_right < n_left)[:, None, None]
            count_right, total_right = np.where(is_right, n, count[own, old] - n), np.where(is_right, t, total[own, old] - t)
            count[own, s + 1], total[own, s + 1] = count_right, total_right
            count[own, old], total[own, old] = count[own, old] - count_right, total[own, old] - total_right
            for which, mark, size in ((old, left, n_left), (np.full(len(own), s + 1), right, n_right)):
                large = np.flatnonzero(size >= 2 * least)
                if not len(large):
                    continue
                j, leaf_of = own[large], which[large]
                squares = (residual[j] ** 2 * mark[large]).sum(1)
                gain[j, leaf_of], feature[j, leaf_of], cut[j, leaf_of] = best_split(count[j, leaf_of], total[j, leaf_of], squares)
        flat = every[:, None] * most + np.maximum(leaf, 0)
        sums = np.bincount(flat[held], weights=residual[held], minlength=jobs * most)
        sizes = np.bincount(flat[held], minlength=jobs * most)
        out.value[:, r] = (rate * sums / np.maximum(sizes, 1)).reshape(jobs, most)
        guess = np.where(held, guess + out.value[every[:, None], r, np.maximum(leaf, 0)], 0.0)
    return out


# ------------------------------------------------------------------ features of a monthly series


def lag_table(values: np.ndarray, first_month: int, season: int) -> tuple[np.ndarray, np.ndarray]:
    """Lags, latest first, their mean and the month's place on the circle, for every row that has all lags; and the targets."""
    n = len(values) - season
    windows = np.lib.stride_tricks.sliding_window_view(values, season)[:n, ::-1]
    months = (first_month - 1 + np.arange(season, len(values))) % 12 + 1
    return np.column_stack([windows, windows.mean(1), *months_on_circle(months)]), values[season:]


def months_on_circle(months: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    angle = 2 * np.pi * months / 12
    return np.sin(angle), np.cos(angle)


def next_features(tails: np.ndarray, month: np.ndarray) -> np.ndarray:
    """Features of the month after each tail (series x season, oldest first)."""
    return np.column_stack([tails[:, ::-1], tails.mean(1), *months_on_circle(month)])


def fold_ends(rows: int, folds: int) -> list[tuple[int, int]]:
    """(rows of training, end of validation) of expanding folds."""
    size = rows // (folds + 1)
    return [(rows - (folds - i) * size, rows - (folds - i - 1) * size) for i in range(folds)]


def rolled(predict, tails: np.ndarray, month: np.ndarray, steps: int) -> np.ndarray:
    """Recursive forecast of many series: predict takes one feature row per series; every prediction becomes the next lag."""
    tails, out = tails.copy(), []
    for step in range(steps):
        guess = predict(next_features(tails, (month - 1 + step) % 12 + 1))
        out.append(guess)
        tails = np.column_stack([tails[:, 1:], guess])
    return np.column_stack(out)


# ------------------------------------------------------------------ models of a batch of series


def forest_forecasts(series: list[tuple[np.ndarray, int]], season: int, holdout: int, horizon: int, folds: int, depths: tuple[int, ...], trees: int, seed: int) -> list[tuple]:
    """Holdout path, forecast, mean one-step error over the folds and depth, for each (values, first month)."""
    out = []
    for values, first in series:
        x, y = lag_table(values[:-holdout], first, season)
        ends = fold_ends(len(y), folds)

        models = [(grow_forest(x[:a], y[:a], bootstrap(a, trees, seed), max(depths)), a, b) for a, b in ends]
        errors = [np.mean([np.abs(y[a:b] - m.cut(depth).predict(x[a:b])).mean() for m, a, b in models]) for depth in depths]
        depth = depths[int(np.argmin(errors))]
        paths = []
        for known, steps in ((values[:-holdout], holdout), (values, horizon)):
            fx, fy = lag_table(known, first, season)
            model = grow_forest(fx, fy, bootstrap(len(fy), trees, seed), depth)
            month = np.array([(first - 1 + len(known)) % 12 + 1])
            paths.append(rolled(model.predict, known[None, -season:], month, steps)[0])
        out.append((*paths, float(min(errors)), float(depth)))
    return out


def boosting_forecasts(series: list[tuple[np.ndarray, int]], season: int, holdout: int, horizon: int, folds: int, leaves: tuple[int, ...], rounds: int) -> list[tuple]:
    """The same for boosting; the fits of all series and folds run side by side."""
    tables = [lag_table(values[:-holdout], first, season) for values, first in series]
    # Sizes of trees that the rows of a fold cannot tell apart share one fit.
    wanted = [(i, n, a, b) for i, (_, y) in enumerate(tables) for n in leaves for a, b in fold_ends(len(y), folds)]
    fit_of = [(i, possible_leaves(a, n), a, b) for i, n, a, b in wanted]
    jobs = list(dict.fromkeys(fit_of))
    model = boost([tables[i][0][:a] for i, _, a, _ in jobs], [tables[i][1][:a] for i, _, a, _ in jobs], [n for _, n, _, _ in jobs], rounds)
    longest = max(b - a for _, _, a, b in jobs)
    held = np.zeros((len(jobs), longest, tables[0][0].shape[1]))
    for k, (i, _, a, b) in enumerate(jobs):
        held[k, : b - a] = tables[i][0][a:b]
    guesses = model.predict(held)
    error = {job: np.abs(tables[job[0]][1][job[2] : job[3]] - guesses[k, : job[3] - job[2]]).mean() for k, job in enumerate(jobs)}
    errors = np.array([error[job] for job in fit_of]).reshape(len(series), len(leaves), folds).mean(2)
    chosen = [leaves[k] for k in errors.argmin(1)]
    paths = []
    for cut, steps in ((holdout, holdout), (0, horizon)):
        known = [values[: len(values) - cut] for values, _ in series]
        fitted = [lag_table(v, first, season) for v, (_, first) in zip(known, series)]
        full = boost([x for x, _ in fitted], [y for _, y in fitted], chosen, rounds)
        month = np.array([(first - 1 + len(v)) % 12 + 1 for v, (_, first) in zip(known, series)])
        paths.append(rolled(lambda x, m=full: m.predict(x[:, None, :])[:, 0], np.array([v[-season:] for v in known]), month, steps))
    return [(paths[0][i], paths[1][i], float(errors[i].min()), float(chosen[i])) for i in range(len(series))]
