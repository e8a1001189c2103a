"""Main-text extraction: gradient-boosted trees over DOM-node features.

Each block element of a page, and each run of text that lies in none, is a node
with features of its own (element,
attribute words), its ancestors, its subtree (text, link and punctuation
density, paragraphs), its depth and place, and its siblings. Boosted trees
give the probability that a node belongs to the main text. Decoding is
hierarchical: the labels kept are the most likely ones among those in which
nothing below a dropped node is kept, found by one pass up and one pass down
the tree.

The trees are trained here on two bounded sets of nodes: pages of random
layouts, whose labels are known (``layouts``), and at most ``SAMPLE_PAGES`` of the
given pages (chosen by a hash of the html), where landmark elements label the nodes: inside article
or main is content, inside nav, footer, aside or form is not, others are left
out, and so is what attribute words announce as another part: a word alone gives no
label. Every page is then read and decoded whole; the trees decide on all text, that outside any block included.

Defined results: a null, empty or textless page gives an empty text; repeated
rows give equal rows; null ids and urls stay null; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitstat.llm.common import batches, text_bytes
from visitstat.llm.dom import BLOCK, Node, features, read
from visitstat.llm.layouts import Layouts
from visitstat.session import write_table

LAYOUT_PAGES = 1200      # generated training pages
SAMPLE_PAGES = 200       # given pages in the training set, at most about this many
TREES, DEPTH, STEP, SEED = 60, 5, 0.25, 7
NEUTRAL = ("ad", "side", "notice", "comment", "share", "form", "menu", "foot")     # words that leave a node unlabelled


class Trees:
    """A boosted ensemble as arrays: per tree and node the feature (-1: leaf), threshold
    (value of a leaf) and the place of the left child, the right one following it."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weights: list[float]):
        self.trees, self.weights = trees, weights

    @classmethod
    def of(cls, model) -> Trees:
        trees = []
        for t in model.trees:
            feature, value, left, todo = [-1], [0.0], [0], [(t._call_java("rootNode"), 0)]
            while todo:
                node, i = todo.pop()
                if node.subtreeDepth() == 0:
                    value[i] = node.prediction()
                    continue
                feature[i], value[i], left[i] = node.split().featureIndex(), node.split().threshold(), len(feature)
                todo += [(node.leftChild(), left[i]), (node.rightChild(), left[i] + 1)]
                feature += [-1, -1]
                value += [0.0, 0.0]
                left += [0, 0]
            trees.append((np.array(feature), np.array(value), np.array(left)))
        return cls(trees, list(model.treeWeights))

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, value, left), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, left[at] + (x[rows, np.maximum(f, 0)] > value[at]), at)
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def landmark_labels(nodes: list[Node]) -> list[int | None]:
    """Labels that the page's own landmark elements give: 1, 0 or none."""
    out: list[int | None] = [None] * len(nodes)
    open_ = [True] * len(nodes)        # false below a part that only words announce
    for i, n in enumerate(nodes[1:], 1):
        kind, up = BLOCK[n.tag], out[n.parent]
        open_[i] = open_[n.parent]
        if kind in ("nav", "aside", "form") or kind == "footer" and up != 1:
            out[i] = 0
        elif kind == "article" and up is None and open_[i]:
            out[i] = 1
        elif n.groups & set(NEUTRAL):
            open_[i] = False
        elif open_[i]:
            out[i] = up
    return out


def training_rows(page: str, landmarks: bool) -> list[tuple[float, list[float]]]:
    nodes, _ = read(page)
    labels = landmark_labels(nodes) if landmarks else [int(n.label) if n.label else None for n in nodes]
    x = features(nodes)
    return [(float(y), x[i].astype(float).tolist()) for i, y in enumerate(labels) if y is not None]


def train(spark: SparkSession, pages: DataFrame | None = None, html: str = "html", layouts: int = LAYOUT_PAGES,
          sample: int = SAMPLE_PAGES) -> Trees:
    """Fit the trees. The training rows are made in tasks and written; the fitted
    ensemble has at most TREES * 2^(DEPTH + 1) numbers."""
    def generated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for seed in b["id"].to_pylist():
                yield _rows(training_rows(Layouts(seed).page(), False))

    def given(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for t in b["t"]:
                yield _rows(training_rows(t.as_py().decode("utf-8", "replace"), True))

    schema = "label double, x array<double>"
    rows = spark.range(0, layouts, 1, 8).mapInArrow(generated, schema)
    if pages is not None:
        h = F.pmod(F.xxhash64(html), F.lit(1 << 30))
        total = max(pages.count(), 1)
        some = pages.filter(h < F.lit(int(min(1.0, sample / total) * (1 << 30)))).select(text_bytes(html).alias("t"))
        rows = rows.union(some.mapInArrow(given, schema))
    data = write_table(rows, "nodes").select("label", array_to_vector("x").alias("features"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, cacheNodeIds=False,
                          minInstancesPerNode=5, subsamplingRate=0.8).fit(data)
    return Trees.of(model)


def _rows(rows: list[tuple[float, list[float]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()),
                                       pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["label", "x"])


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the most likely labels with nothing kept below a dropped node.

    A node counts by its own text and its part in the structure; the page itself is kept.
    """
    p = np.clip(p, 0.01, 0.99)
    weight = np.array([1.0 + np.log2(1 + n.own) for n in nodes])
    yes, no = weight * np.log(p), weight * np.log(1 - p)
    yes[0] = no[0] = 0.0
    drop, best = no.copy(), yes.copy()              # of whole subtrees
    for i in range(len(nodes) - 1, 0, -1):          # children come after their parents
        best[i] = max(best[i], drop[i])
        drop[nodes[i].parent] += drop[i]
        best[nodes[i].parent] += best[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and best[i] > drop[i]
    return kept


def extract_pages(pages: list[str], trees: Trees) -> list[str]:
    """The main text of each page: the kept nodes' blocks in page order."""
    parsed = [read(p) for p in pages]
    x = [features(n) for n, _ in parsed]
    p = trees.probability(np.concatenate(x)) if x else np.zeros(0)
    out, at = [], 0
    for nodes, segments in parsed:
        kept = decode(nodes, p[at:at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(t for i, t in segments if kept[i]))
    return out


def extract(pages: DataFrame, trees: Trees, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    src = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), text_bytes(html).alias("t"))
    schema = T.StructType([src.schema["page_id"], src.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, rows=256, size=2 << 20):
            got = extract_pages([t.as_py().decode("utf-8", "replace") for t in b["t"]], trees)
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(got, pa.string()),
                                              pa.array([len(t) for t in got], pa.int64())], [f.name for f in schema])

    return src.mapInArrow(run, schema)
