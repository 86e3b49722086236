"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every block element and text block has a hidden label: main text or not. Features of a node (names in class and id, lengths, links, place
on the page) give its own potential, and pairs of parent and child have a potential by kind of child. Sum-product
messages go up from the leaves and down from the root, which on a tree gives exact marginals; text blocks with a marginal of one half or more are the
main text. Potentials are trained on labelled pages by the exact gradient of the likelihood, which the same messages give.

Messages run over all pages of a batch at once, a depth at a time. A page is read and judged as a whole; batches are cut by text, and a
longer page is a batch of its own. NULL and empty pages, and pages without main text, give an empty text. Every row of the table is judged by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.columns import boxed
from talentweave.llm.dom import Tree, parse
from talentweave.llm.layouts import labelled_pages
from talentweave.llm.words import slices

TRAINING_PAGES = 900
LEAST = 3  # training nodes that a feature needs
STEPS, RATE, DECAY = 160, 0.12, 3e-4
THRESHOLD = 0.5

_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SENTENCE = re.compile(r"[.!?。！？](?:\s|$)")
#: Upper ends of steps, in which numbers are features.
WORD_STEPS = np.array([1, 2, 4, 8, 16, 32, 64, 128, 512])
SHARE_STEPS = np.array([0.01, 0.2, 0.5, 0.8])


@lru_cache(maxsize=1 << 14)
def _names(value: str) -> tuple[str, ...]:
    found = dict.fromkeys(w.lower() for w in _NAME.findall(value))
    return tuple(f"name:{w}" for w in found if len(w) > 1) + (f"names:{'-'.join(found)}",)


def features(tree: Tree) -> tuple[list[list[str]], list[list[str]]]:
    """Names of the features of each node, and of the pair of each node and its parent."""
    n = len(tree.parent)
    chars, linked, words, ends, blocks = ([0] * n for _ in range(5))
    for i, text in enumerate(tree.text):
        if text:
            chars[i], linked[i], words[i], ends[i], blocks[i] = len(text), tree.linked[i], text.count(" ") + 1, len(_SENTENCE.findall(text)), 1
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        for sums in (chars, linked, words, ends, blocks):
            sums[p] += sums[i]
    steps = np.searchsorted(WORD_STEPS, words).tolist()
    shares = np.searchsorted(SHARE_STEPS, np.array(linked) / np.maximum(1, chars)).tolist()
    total, seen = max(1, chars[0]), 0
    own: list[list[str]] = []
    pair: list[list[str]] = []
    for i in range(n):
        tag = tree.tag[i]
        if not tag:
            above = tree.tag[tree.parent[i]]
            text = tree.text[i]
            found = [
                "text", f"text in {above}", f"text {steps[i]}", f"text links {shares[i]}", f"text {steps[i]} links {shares[i]}", f"text ends {min(ends[i], 3)}",
                f"text at {min(4, 5 * seen // total)}", f"text share {int(np.searchsorted(SHARE_STEPS, chars[i] / total))}"]
            if "©" in text or "opyright" in text:
                found.append("text rights")
            if text[-1] not in ".!?":
                found.append("text open")
            seen += chars[i]
            own.append(found)
            pair.append(["pair", "pair text", f"pair text in {above}"])
            continue
        found = ["element", f"tag {tag}", f"{tag} {steps[i]}", f"element links {shares[i]}", f"element {steps[i]} links {shares[i]}",
                 f"element sentences {min(4, ends[i])}", f"element blocks {min(4, blocks[i])}",
                 f"element share {int(np.searchsorted(SHARE_STEPS, chars[i] / total))}"]
        names: tuple[str, ...] = ()
        for key in ("class", "id", "role"):
            if value := tree.attributes[i].get(key):
                names += _names(value)
        if "hidden" in tree.attributes[i] or "none" in tree.attributes[i].get("style", ""):
            names += ("not shown",)
        own.append(found + list(dict.fromkeys(names)))
        pair.append(["pair", f"pair {tag}", *(["pair named"] if names else [])])
    return own, pair


class Forest:
    """Trees side by side: parents, depths and numbers of features of all nodes, unknown features left out."""

    def __init__(self, trees: list[Tree], own_index: dict[str, int], pair_index: dict[str, int]):
        sizes = [len(t.parent) for t in trees]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype("int64")
        self.parent = np.concatenate([[], *[np.array(t.parent) + s for t, s in zip(trees, self.starts)]]).astype("int64")
        depth = np.concatenate([[], *[t.depth for t in trees]]).astype("int64")
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1))) if len(depth) else []
        self.of_root = depth == 0
        lists: tuple[list[int], ...] = [], [], [], []
        node = 0
        for tree in trees:
            for own, pair in zip(*features(tree)):
                for names, index, at, owner in ((own, own_index, *lists[:2]), (pair, pair_index, *lists[2:])):
                    known = [index[f] for f in names if f in index]
                    at += known
                    owner += [node] * len(known)
                node += 1
        self.own, self.own_node, self.pair, self.pair_node = (np.array(x, "int64") for x in lists)
        self.nodes = node


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(*np.moveaxis(values, axis, 0))


def marginals(forest: Forest, own: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of nodes (n, 2) and of parent and child (n, 2, 2), and the log of the sum over all labellings of each node's tree at its root.

    ``own`` (n, 2) and ``pair`` (n, parent's label, child's label) are log potentials; those of roots' pairs are ignored.
    """
    belief, up = own.copy(), np.zeros_like(own)
    for level in reversed(forest.levels[1:]):
        up[level] = _log_sum(pair[level] + belief[level][:, None, :], 2)
        np.add.at(belief, forest.parent[level], up[level])
    full = belief.copy()
    both = np.zeros_like(pair)
    for level in forest.levels[1:]:
        rest = full[forest.parent[level]] - up[level]  # all that the parent knows but for this child
        joint = pair[level] + rest[:, :, None]
        full[level] += _log_sum(joint, 1)
        joint = joint + belief[level][:, None, :]
        both[level] = np.exp(joint - _log_sum(_log_sum(joint, 2), 1)[:, None, None])
    total = _log_sum(full, 1)
    return np.exp(full - total[:, None]), both, total


def _gold(tree: Tree) -> np.ndarray:
    """Labels of a labelled page: of text by the closest mark above, of elements by most of their text."""
    n = len(tree.parent)
    mark, inside, all_chars = [0] * n, [0] * n, [0] * n
    for i in range(n):
        mark[i] = int(tree.attributes[i]["main"]) if "main" in tree.attributes[i] else mark[tree.parent[i]]
        all_chars[i], inside[i] = len(tree.text[i]), len(tree.text[i]) * mark[i]
    for i in range(n - 1, 0, -1):
        inside[tree.parent[i]] += inside[i]
        all_chars[tree.parent[i]] += all_chars[i]
    return np.array([mark[i] if not all_chars[i] else int(2 * inside[i] > all_chars[i]) for i in range(n)])


class TreeModel:
    """Weights of features of nodes and of pairs of parent and child."""

    def __init__(self, own_index: dict[str, int], pair_index: dict[str, int]):
        self.own_index, self.pair_index = own_index, pair_index
        self.own = np.zeros((len(own_index), 2))
        self.pair = np.zeros((len(pair_index), 2, 2))

    def potentials(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        own = np.stack([np.bincount(forest.own_node, self.own[forest.own, y], forest.nodes) for y in (0, 1)], axis=1)
        pair = np.stack([
            np.bincount(forest.pair_node, self.pair[forest.pair, a, b], forest.nodes) for a in (0, 1) for b in (0, 1)], axis=1)
        return own, pair.reshape(-1, 2, 2)

    def fit(self, forest: Forest, gold: np.ndarray, steps: int = STEPS) -> list[float]:
        """Adam on the likelihood of the labels with decay; returns the mean loss of each step."""
        child = ~forest.of_root
        wanted, wanted_pair = np.eye(2)[gold], np.zeros((forest.nodes, 2, 2))
        wanted_pair[np.flatnonzero(child), gold[forest.parent[child]], gold[child]] = 1
        weights, slopes, squares = [self.own, self.pair], [0, 0], [0, 0]
        losses = []
        for step in range(1, steps + 1):
            own, pair = self.potentials(forest)
            single, both, total = marginals(forest, own, pair)
            losses.append(float(total[forest.of_root].sum() - (own * wanted).sum() - (pair * wanted_pair).sum()) / len(gold))
            off, off_pair = single - wanted, (both - wanted_pair).reshape(-1, 4)
            grads = [
                np.stack([np.bincount(forest.own, off[forest.own_node, y], len(self.own)) for y in (0, 1)], axis=1),
                np.stack([np.bincount(forest.pair, off_pair[forest.pair_node, k], len(self.pair)) for k in range(4)], axis=1).reshape(-1, 2, 2)]
            for k, grad in enumerate(grads):
                grad = grad / len(gold) + DECAY * weights[k]
                slopes[k] = 0.9 * slopes[k] + 0.1 * grad
                squares[k] = 0.99 * squares[k] + 0.01 * grad * grad
                weights[k] -= RATE * (slopes[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-8)
        return losses

    def main(self, trees: list[Tree]) -> list[np.ndarray]:
        """Of each tree the probability of each node to be main text."""
        if not trees:
            return []
        forest = Forest(trees, self.own_index, self.pair_index)
        single = marginals(forest, *self.potentials(forest))[0][:, 1]
        return np.split(single, forest.starts[1:-1])


def trained(pages: list[str] | None = None, least: int = LEAST, steps: int = STEPS) -> TreeModel:
    """A model of labelled pages (``layouts``); by default of ``TRAINING_PAGES`` made ones."""
    trees = [parse(p) for p in (labelled_pages(TRAINING_PAGES) if pages is None else pages)]
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for tree in trees:
        for side, found in zip(counts, features(tree)):
            side.update(f for names in found for f in names)
    model = TreeModel(*({f: i for i, f in enumerate(sorted(f for f, n in side.items() if n >= least))} for side in counts))
    forest = Forest(trees, model.own_index, model.pair_index)
    model.fit(forest, np.concatenate([_gold(t) for t in trees]), steps)
    return model


def main_texts(pages: list[str], model: TreeModel, threshold: float = THRESHOLD) -> list[str]:
    """Blocks of main text of each page in page order, one to a line."""
    trees = [parse(p) for p in pages]
    return [
        "\n".join(t for t, p in zip(tree.text, shares.tolist()) if t and p >= threshold) for tree, shares in zip(trees, model.main(trees))]


def extracted(pages: DataFrame, model: TreeModel | None = None, threshold: float = THRESHOLD, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the main text as the column ``out``; a column of that name is replaced."""
    held = pages.sparkSession.sparkContext.broadcast(model or trained())  # as large as the layouts make it, whatever the data

    @F.arrow_udf("string")
    def text_of(html: pa.Array) -> pa.Array:
        found: list[str] = []
        for part in slices(html):
            found += main_texts(pc.fill_null(part, "").to_pylist(), held.value, threshold)
        return pa.array(found, pa.string())

    rows, (html,) = boxed(pages, html_col)
    found = rows.withColumn("_text", text_of(F.col(html)))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(pages.columns) if c != out]
    return found.select(*kept, F.col("_text").alias(out))
