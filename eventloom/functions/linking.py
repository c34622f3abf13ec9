"""Helpers of one task that links titles: candidates by words or characters, and groups of what is linked.

Titles are texts of sorted distinct words (see ``token_set``).  Only groups are asked for, so that a pair whose
two sides are in one group already is not looked at again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from .similarity import in_common, sharing_pairs, token_set

_SLACK = 1e-9
#: Titles whose words are looked up together, rows that are expanded at once, pairs scored between two looks at the groups.
TOGETHER, MOST, SCORED = 64, 1 << 20, 128


def pieces(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows that together count up to ``most``, one row at least."""
    ends, at = np.cumsum(counts), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - counts[at] + most, "right")))
        yield slice(at, to)
        at = to


def expanded(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` places from each start: the row, and the place."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, the least member of each one's group, after the groups of each a and b are joined."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def common_words(texts: list[str], others: list[str], share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a text and another that can have ``share`` of the former's characters in common words: places of both, and
    the characters of the common words, with a blank after each.

    The words that begin a text's list, rare ones first, up to ``1 - share`` of it, are looked up among the words of the others."""
    known: dict[str, int] = {}
    sides = [[t.split(" ") for t in ts] for ts in (texts, others)]
    n, m = (np.array([len(ws) for ws in side], np.int64) for side in sides)
    codes, held = (np.array([known.setdefault(w, len(known)) for ws in side for w in ws], np.int64) for side in sides)
    of, held_of = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
    length = np.array([len(w) + 1 for w in known], np.int64)
    weight, held_weight = (np.bincount(o, length[c], len(k)) for o, c, k in ((of, codes, n), (held_of, held, m)))
    found = np.bincount(held, minlength=len(known))
    by_word, at = held_of[np.argsort(held, kind="stable")], np.cumsum(found) - found
    order, start, held_start = np.lexsort((codes, found[codes], of)), np.cumsum(n) - n, np.cumsum(m) - m
    codes = codes[order]
    before = np.cumsum(length[codes]) - length[codes]
    before = before - before[start][of]
    begins = np.flatnonzero((before <= (1 - share) * weight[of] + _SLACK) & (found[codes] > 0))
    mark = np.zeros((TOGETHER, len(known)), bool)
    for low in range(0, len(texts), TOGETHER):
        a, b = np.searchsorted(of[begins], [low, low + TOGETHER])
        if a == b:
            continue
        own = slice(start[low], start[low] + n[low : low + TOGETHER].sum())
        mark[of[own] - low, codes[own]] = True
        here = begins[a:b]
        for part in pieces(found[codes[here]], MOST):
            row, place = expanded(found[codes[here[part]]], at[codes[here[part]]])
            i, j = of[here[part]][row], by_word[place]
            enough = held_weight[j] - 1 >= share * (weight[i] - 1) - _SLACK
            i, j = np.divmod(np.unique(i[enough] * len(others) + j[enough]), len(others))
            for some in pieces(m[j], MOST):
                x, y = i[some], j[some]
                row, place = expanded(m[y], held_start[y])
                word = held[place]
                both = np.bincount(row, length[word] * mark[x[row] - low, word], len(x))
                near = both - 1 >= share * (weight[x] - 1) - _SLACK
                yield x[near], y[near], both[near].astype(np.int64)
        mark[of[own] - low, codes[own]] = False


class Nodes:
    """The kinds (title, location) of one or two blocks, and the groups that they are in.

    ``kinds(other, tid, text, size, location, rep)`` has those of both blocks.  A title that has a kind without a location has no
    other kind here.  Two kinds of like titles are linked if a location is empty or both are the same.  Titles go by ``tid`` in
    the order of their names, which a score can depend on."""

    def __init__(self, kinds: pd.DataFrame, threshold: float):
        kinds = kinds.sort_values(["other", "size", "tid"], kind="stable", ignore_index=True)
        first = ~kinds.duplicated("tid").to_numpy()
        self.threshold, self.share = threshold, threshold / (2 - threshold)
        self.tid, self.texts = kinds["tid"].to_numpy()[first], kinds["text"][first].tolist()
        self.sizes, self.rep = kinds["size"].to_numpy()[first], kinds["rep"].to_numpy()
        self.title = np.cumsum(first) - 1
        self.count = np.bincount(self.title, minlength=len(self.tid))
        self.start = np.cumsum(self.count) - self.count
        self.place, places = pd.factorize(kinds["location"])
        self.open = np.full(len(self.tid), -1)
        bare = np.flatnonzero(kinds["location"].to_numpy() == "")
        self.open[self.title[bare]] = bare
        self.places = len(places)
        self.keys = self.title * self.places + self.place
        self.by_key = np.argsort(self.keys, kind="stable")
        self.root = np.arange(len(kinds))
        if "group" in kinds:
            at = kinds["group"].drop_duplicates()
            self.root = at.index.to_numpy()[pd.Index(at).get_indexer(kinds["group"])]
        self.known = self.root.copy()
        self.left = int((~kinds["other"].to_numpy()[first]).sum())

    def edges(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pair, and both kinds, of each link that pairs of like titles make."""
        bare, found = self.open[i] >= 0, []
        for one, two, rows in ((i, j, np.flatnonzero(bare)), (j, i, np.flatnonzero(~bare & (self.open[j] >= 0)))):
            row, kind = expanded(self.count[two[rows]], self.start[two[rows]])
            found.append((rows[row], self.open[one[rows]][row], kind))
        rows = np.flatnonzero(~bare & (self.open[j] < 0))
        row, kind = expanded(self.count[i[rows]], self.start[i[rows]])
        key, ordered = j[rows][row] * self.places + self.place[kind], self.keys[self.by_key]
        at = np.minimum(np.searchsorted(ordered, key), len(ordered) - 1)
        same = ordered[at] == key
        found.append((rows[row[same]], kind[same], self.by_key[at[same]]))
        return tuple(np.concatenate(column) for column in zip(*found, strict=True))

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of titles would link what is not in one group yet."""
        pair, a, b = self.edges(i, j)
        out = np.zeros(len(i), bool)
        out[pair[self.root[a] != self.root[b]]] = True
        return out

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        for part in pieces(self.count[i] + self.count[j], MOST):
            _, a, b = self.edges(i[part], j[part])
            self.root = merged(self.root, a, b)

    def link_alike(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links the pairs whose score is at the threshold, where it matters."""
        for at in range(0, len(i), SCORED):
            a, b = i[at : at + SCORED], j[at : at + SCORED]
            some = self.apart(a, b)
            a, b = a[some], b[some]
            swap = self.tid[a] > self.tid[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            like = [token_set(self.texts[x], self.texts[y], self.threshold) >= self.threshold for x, y in zip(a, b, strict=True)]
            like = np.array(like, bool)
            self.link(a[like], b[like])

    def link_by_words(self) -> None:
        """Links titles whose common words are all of one of them, or make up enough of it."""
        titles = np.arange(len(self.tid))
        left, right = titles[: self.left], titles[self.left :]
        for one, two in [(left, right), (right, left)] if len(right) else [(left, left)]:
            for i, j, both in common_words([self.texts[k] for k in one], [self.texts[k] for k in two], self.share):
                i, j = one[i], two[j]
                i, j, both = (c[i != j] for c in (i, j, both))
                sure = np.zeros(len(i), bool)
                for k in (i, j):
                    size = self.sizes[k]
                    sure |= (both > size) | ((size < 200) & (2 * (both - 1) / np.maximum(both - 1 + size, 1) >= self.threshold))
                self.link(i[sure], j[sure])
                self.link_alike(i[~sure], j[~sure])

    def link_by_characters(self) -> None:
        """Links titles in different groups whose ratio is at the threshold.  Those of the largest group are not compared with each other."""
        group = self.root[self.start]  # of a title, or one of its own if its kinds are in several
        several = np.unique(self.title[self.root != group[self.title]])
        group[several] = -1 - several
        most = pd.Series(group).mode().iloc[0] if len(group) else 0
        titles = np.arange(len(group))
        left, right = titles[: self.left], titles[self.left :]
        if len(right):
            sides = [(left[group[left] != most], right), (left[group[left] == most], right[group[right] != most])]
        else:
            rest = left[group[left] != most]
            sides = [(rest, rest), (rest, left[group[left] == most])]
        for one, two in sides:
            texts, others = [self.texts[k] for k in one], [self.texts[k] for k in two]
            for i, j, needed in sharing_pairs(texts, others, self.threshold, one is two, group[one], group[two]):
                i, j = one[i], two[j]
                some = self.apart(i, j)
                i, j, needed = i[some], j[some], needed[some]
                if len(i):
                    near = in_common([self.texts[k] for k in j], [self.texts[k] for k in i], True) >= needed
                    self.link_alike(i[near], j[near])

    def links(self) -> pd.DataFrame:
        """What was linked: a kind and one of its group, as few as join what was not in one group before."""
        new = np.flatnonzero(self.root[self.known] != self.known)
        new = new[self.known[new] == new]
        return pd.DataFrame({"src": self.rep[new], "dst": self.rep[self.root[new]]})
