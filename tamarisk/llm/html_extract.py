"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a binary variable: content or not. Unary potentials are linear in features of the element (tag, names in
class, id and role, text, links, place); pairwise potentials couple an element with its parent and depend on the kind of
the element. Trees have no loops, so one pass of messages up and one down gives exact marginals; both run depth by depth
over all pages of a batch at once. Weights are fitted to labelled pages by the gradient of the exact likelihood.
Text whose element is likelier content than not is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tamarisk.llm.arrow import sliced
from tamarisk.llm.dom import INLINE, Dom, joined, parse
from tamarisk.llm.html_pages import labelled_page
from tamarisk.llm.tables import held, let_go, passed_through

TRAIN_PAGES = 1_000
#: Elements by what their parent's label means for theirs.
SECTIONS = {"nav", "header", "footer", "aside", "form", "article", "main", "section", "body", "html"}
#: What stands right in these says little of their children: they hold whatever the page has.
OUTER = {"#page", "html", "body"}
KINDS = 4
_NAME = re.compile(r"[a-z]+")


def _kind(tag: str, parent: str) -> int:
    return 0 if tag in INLINE else 3 if parent in OUTER else 1 if tag in SECTIONS else 2


def element_kinds(dom: Dom) -> list[tuple]:
    """What tells elements apart: tag, outer element, and magnitudes of direct text, text, links and sentence ends; and names."""
    n = len(dom.tag)
    text, links, stops, direct = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[dom.parent[i]] or dom.tag[i] == "a"
    for _, i, t in dom.chunks:
        k = len(t.strip())
        direct[i] += k
        links[i] += k if inside[i] else 0
        stops[i] += sum(t.count(c) for c in ".,!?")
    text += direct
    for i in range(n - 1, 0, -1):
        p = dom.parent[i]
        text[p], links[p], stops[p] = text[p] + text[i], links[p] + links[i], stops[p] + stops[i]
    size = lambda x: (np.log2(x + 1).astype(int) // 2).tolist()
    linked, ends = (4 * links / np.maximum(text, 1)).astype(int).tolist(), (np.minimum(stops, 15).astype(int) // 3).tolist()
    outer = ["", *(dom.tag[p] if dom.tag[p] in OUTER else "others" for p in dom.parent[1:])]
    return list(zip(dom.tag, outer, size(direct), size(text), linked, ends, dom.names, strict=True))


def feature_names(kind: tuple) -> list[str]:
    """Names of the features of such an element."""
    tag, outer, direct, length, links, stops, named = kind
    names = dict.fromkeys(_NAME.findall(named.lower()))
    own = ["bias", f"tag={tag}", f"{tag} in {outer or 'others'}", f"direct={tag in OUTER} {direct}", f"length={length}", f"links={links}", f"stops={stops}"]
    return own + [f"name={w}" for w in names] + (["named"] if names else [f"plain {tag}"])


@dataclass
class Forest:
    """Elements of several pages. parent is -1 at roots; a parent comes before its children."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    row: np.ndarray
    feature: np.ndarray

    @staticmethod
    def of(doms: list[Dom], index: dict[str, int], grow: bool = False) -> Forest:
        parent, depth, kind, row, feature = [], [], [], [], []
        known: dict[tuple, list[int]] = {}
        for dom in doms:
            base = len(parent)
            for i, own in enumerate(element_kinds(dom)):
                p = dom.parent[i]
                parent.append(base + p if p >= 0 else -1)
                depth.append(depth[base + p] + 1 if p >= 0 else 0)
                kind.append(_kind(dom.tag[i], dom.tag[p] if p >= 0 else ""))
                if (found := known.get(own)) is None:
                    names = feature_names(own)
                    found = known[own] = [index.setdefault(x, len(index)) for x in names] if grow else [index[x] for x in names if x in index]
                row += [base + i] * len(found)
                feature += found
        return Forest(*(np.array(x, np.int64) for x in (parent, depth, kind, row, feature)))


@dataclass
class Weights:
    index: dict[str, int]
    unary: np.ndarray
    #: By kind: log potentials of (parent's label, own label).
    pair: np.ndarray


def marginals(forest: Forest, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Of each element: probabilities of its label, and of (parent's label, own label) pairs (zero at roots)."""
    n = len(forest.parent)
    local = np.zeros((n, 2))
    local[:, 1] = np.bincount(forest.row, weights.unary[forest.feature], n) if n else 0
    order = np.argsort(forest.depth, kind="stable")
    bounds = np.searchsorted(forest.depth[order], np.arange(forest.depth.max() + 2)) if n else [0]
    layers = [order[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    pair = weights.pair[forest.kind]
    gathered, up = local.copy(), np.zeros((n, 2))
    for layer in reversed(layers[1:]):  # to the roots
        up[layer] = np.logaddexp.reduce(pair[layer] + gathered[layer][:, None, :], axis=2)
        np.add.at(gathered, forest.parent[layer], up[layer])
    belief, both = gathered.copy(), np.zeros((n, 2, 2))
    for layer in layers[1:]:  # and back
        rest = belief[forest.parent[layer]] - up[layer]
        joint = pair[layer] + rest[:, :, None] + gathered[layer][:, None, :]
        belief[layer] = np.logaddexp.reduce(joint, axis=1)
        both[layer] = np.exp(joint - np.logaddexp.reduce(joint, axis=(1, 2))[:, None, None])
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None]), both


def fit(pages: list[str], steps: int = 120, ridge: float = 0.02) -> Weights:
    """From pages whose elements carry 0 or 1 in data-y; an element without takes its parent's."""
    doms = [parse(p) for p in pages]
    index: dict[str, int] = {}
    forest = Forest.of(doms, index, grow=True)
    label: list[int] = []
    for dom in doms:
        base = len(label)
        for i, mark in enumerate(dom.mark):
            label.append(int(mark) if mark else label[base + dom.parent[i]] if i else 0)
    y = np.array(label)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    w = Weights(index, np.zeros(len(index)), np.log(seen + 1) - np.log((seen + 1).sum(2, keepdims=True)))
    there = np.bincount(forest.feature, y[forest.row], len(index))
    moments = [np.zeros(len(index)), np.zeros(len(index)), np.zeros((KINDS, 2, 2)), np.zeros((KINDS, 2, 2))]
    for step in range(1, steps + 1):
        own, both = marginals(forest, w)
        grad_u = (np.bincount(forest.feature, own[forest.row, 1], len(index)) - there) / len(pages) + ridge * w.unary / len(pages)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, forest.kind[child], both[child])
        for at, (grad, value) in enumerate(((grad_u, w.unary), ((expected - seen) / len(pages), w.pair))):
            moments[2 * at] = 0.9 * moments[2 * at] + 0.1 * grad
            moments[2 * at + 1] = 0.99 * moments[2 * at + 1] + 0.01 * grad**2
            value -= 0.15 * (moments[2 * at] / (1 - 0.9**step)) / (np.sqrt(moments[2 * at + 1] / (1 - 0.99**step)) + 1e-6)
    return w


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return fit([labelled_page(i) for i in range(TRAIN_PAGES)])


def extract(pages: list[str], weights: Weights) -> list[str]:
    doms = [parse(p) for p in pages]
    likely = marginals(Forest.of(doms, weights.index), weights)[0][:, 1] > 0.5
    out, base = [], 0
    for dom in doms:
        out.append(joined([c for c in dom.chunks if likely[base + c[1]]]))
        base += len(dom.tag)
    return out


def _extracted(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            texts = [t for at in range(0, len(html), 200) for t in extract(html[at : at + 200], weights.value)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    return run


def main_text(pages: DataFrame, html_col: str = "html", columns: tuple[str, ...] = ("page_id", "url"), weights: Weights | None = None) -> DataFrame:
    """The named columns of every row, with text (blocks joined by two line ends; empty if none) and n_chars.

    A null or empty page has no text. Broken markup is read as far as it goes, and long pages are read whole, in time in
    proportion to their length. Repeated rows and rows with nulls in other columns are treated like any other, an empty
    table gives no rows. A column text or n_chars of the input gives way to the result of that name.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or default_weights())
    columns = passed_through(pages, columns, ("text", "n_chars"))
    own = pages.select(held(columns), F.col(html_col).cast("string").alias("html"))
    found = own.mapInArrow(sliced(_extracted(shared)), StructType([own.schema[0], StructField("text", StringType()), StructField("n_chars", LongType())]))
    return found.select(*let_go(columns), "text", "n_chars")
