"""Main text of web pages by boosted trees over DOM-node features.

A page's block elements are the nodes; inline elements belong to their block, and what
a browser never shows (scripts, styles, comments, the head) is no text. Every node has
features of its tag, its attributes' words, its depth, its subtree's text and link
density, and its siblings; Spark's gradient-boosted trees, fitted on a bounded sample of
pages, give each the log odds of holding article text. Decoding is hierarchical: the
labels with the largest total log probability are chosen among those where no content
node stands below a boilerplate one, by one pass from the leaves up.

Labels for fitting come from the document that a page's URL names: a node whose text is
one of the document's lines is content. Pages without such a document take their
``article`` and ``main`` elements. The same texts are also put into varied layouts with
menus, notices, comments and forms in other places, so that the trees learn from words
in attributes too.

Text of the chosen nodes: character references decoded, white space inside a block as
one space, blocks in page order joined by one space. Null or empty html gives an empty
text. Broken html is read as far as it goes; a tag that is cut off at the end is dropped.
Repeated rows get equal texts. Other columns are ignored.
"""

from __future__ import annotations

import html as references
import random
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.common import slices, unit_hash

#: Largest number of pages that the trees are fitted on.
SAMPLE_PAGES = 300
LAYOUTS = 3
TREES, DEPTH = 20, 4

OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
SPECIAL = re.compile(r"[>\"']")
CUT_OFF = re.compile(r"<(?:[/!?]|[a-zA-Z])[^<>]*\Z")
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNSEEN = frozenset("head script style noscript template title svg math iframe object canvas audio video select textarea".split())
RAW = frozenset(("script", "style", "title", "textarea", "noscript", "iframe"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp "
                    "small span strike strong sub sup time tt u var br wbr img").split())
FURNITURE = frozenset("nav footer header aside form dialog menu button fieldset".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: A start tag of the key closes an open element of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset(("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                      "pre section table ul").split())
FURNITURE_WORDS = frozenset(("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie "
                             "cookies disclaimer discussion disqus footer form header login menu modal nav navbar navigation "
                             "newsletter notice notification overlay pager pagination popup promo recommended related replies "
                             "reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription tags "
                             "toolbar widget").split())
ARTICLE_WORDS = frozenset("article body content entry main post story text".split())
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "search": "form",
         "dialog": "modal", "alert": "notice", "form": "form"}
FEATURES = ("heading", "paragraph", "item", "table", "division", "furniture_tag", "article_tag", "furniture_words", "article_words",
            "furniture_above", "article_above", "hidden", "depth", "own_chars", "chars", "own_links", "links", "tags_per_char",
            "children", "place", "siblings", "same_siblings", "sibling_chars", "text_share", "stops_per_char")


class Node:
    __slots__ = ("tag", "parent", "attributes", "children", "runs", "own", "linked", "depth", "chars", "links", "tags", "stops")

    def __init__(self, tag: str, parent: "Node | None", attributes: str):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node] = []
        self.runs: list[tuple[int, str]] = []  # place on the page, text
        self.own = self.linked = self.chars = self.links = self.tags = self.stops = 0
        self.depth = parent.depth + 1 if parent else 0


class Markup:
    """Tags and comments of a page, in one way forward: a search that failed isn't repeated, so
    the time stays in proportion to the page however broken it is."""

    def __init__(self, page: str):
        self.page = page
        self.special = [m.start() for m in SPECIAL.finditer(page)]
        self.last = page.rfind(">")
        self.ends: dict[int, int] = {}  # by the place of a mark outside quotes

    def tag_end(self, at: int) -> int:
        """Place of the first > outside quotes, or -1."""
        seen = []
        while True:
            i = bisect_left(self.special, at)
            if i == len(self.special):
                end = -1
                break
            mark = self.special[i]
            if mark in self.ends:
                end = self.ends[mark]
                break
            seen.append(mark)
            if self.page[mark] == ">":
                end = mark
                break
            at = self.page.find(self.page[mark], mark + 1) + 1
            if not at:  # the quote isn't closed
                end = -1
                break
        self.ends.update(dict.fromkeys(seen, end))
        return end

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it closes, name (none for comments) and attributes."""
        while m := OPENING.search(self.page, at):
            if m[1]:
                end = self.page.find("-->", m.end())
                return m.start(), end + 3 if end >= 0 else len(self.page), False, "", ""
            end = -1
            if m.end() <= self.last:
                end = self.page.find(">", m.end()) if m[2] else self.tag_end(m.end())
            if end >= 0:
                return m.start(), end + 1, bool(m[3]), (m[4] or "").lower(), self.page[m.end() : end] if m[4] else ""
            at = m.start() + 1
        return None


def parse(page: str) -> list[Node]:
    """Block nodes in page order; parents come before their children."""
    last = page.rfind("<")
    page = page[:last] if last > page.rfind(">") and CUT_OFF.match(page, last) else page
    root = Node("html", None, "")
    nodes, now, at, anchor, unseen = [root], root, 0, 0, ""
    place, pending = 0, []

    def close_run():
        nonlocal place
        text = " ".join(references.unescape("".join(pending)).split())
        pending.clear()
        if text:
            now.runs.append((place, text))
            now.own += len(text)
            now.stops += sum(map(text.count, ".,!?;:"))
            place += 1

    markup, open_ = Markup(page), Counter()

    def leave():
        nonlocal now
        open_[now.tag] -= 1
        now = now.parent

    while token := markup.next(at):
        start, end, closing, tag, attributes = token
        if not unseen and start > at:
            piece = page[at:start]
            pending.append(piece)
            if anchor:
                now.linked += len(piece)
        at = end
        if not tag:
            continue
        if unseen:
            if closing and tag == unseen:
                unseen = ""
            continue
        if tag in UNSEEN:
            if not closing and not attributes.endswith("/"):
                if tag in RAW:  # their content is no markup
                    stop = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                    at = stop.end() if stop else len(page)
                else:
                    unseen = tag
            continue
        now.tags += not closing
        if tag in INLINE:
            if tag == "a":
                anchor = max(0, anchor + (-1 if closing else 1))
            elif tag == "br":
                pending.append(" ")
            continue
        if tag in VOID:
            close_run()
            continue
        close_run()
        anchor = 0
        if closing:
            if open_[tag]:  # else it closes nothing
                while now.tag != tag:
                    leave()
                leave()
            continue
        if tag in ("html", "body") and not now.parent:
            if tag == "body":
                now.attributes = attributes
            continue
        if tag in CLOSES_P and now.tag == "p":
            leave()
        elif now.tag in CLOSES.get(tag, ()):
            while now.tag in CLOSES[tag]:
                leave()
        child = Node(tag, now, attributes)
        now.children.append(child)
        nodes.append(child)
        now = child
        open_[tag] += 1
    if not unseen:
        pending.append(page[at:])
        close_run()
    for node in reversed(nodes):
        node.chars += node.own
        node.links += min(node.linked, node.own)
        if node.parent:
            for field in ("chars", "links", "tags", "stops"):
                setattr(node.parent, field, getattr(node.parent, field) + getattr(node, field))
    return nodes


def attribute_words(attributes: str) -> tuple[set[str], bool]:
    """Lower-case words of class, id, role and the like, and whether the element is hidden."""
    found, hidden = set(), False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop", "data-role", "aria-label"):
            found.update(w.lower() for w in WORD.findall(value))
            if name == "role" and value.lower() in ROLES:
                found.add(ROLES[value.lower()])
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
    return found, hidden or bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes))


def node_features(nodes: list[Node]) -> np.ndarray:
    total = max(1, nodes[0].chars)
    out = np.zeros((len(nodes), len(FEATURES)))
    above: dict[int, tuple[int, int]] = {}
    lot: dict[int, tuple] = {}
    for i, node in enumerate(nodes):
        words, hidden = attribute_words(node.attributes) if node.attributes.strip() else ((), False)
        words = set(words)
        bad, good = len(words & FURNITURE_WORDS), len(words & ARTICLE_WORDS)
        bad_tag, good_tag = node.tag in FURNITURE, node.tag in ARTICLE
        over_bad, over_good = above[id(node.parent)] if node.parent else (0, 0)
        above[id(node)] = (over_bad + bad_tag + (bad > 0), over_good + good_tag + (good > 0))
        place = siblings = same = around = 0.0
        if node.parent:
            key = id(node.parent)
            if key not in lot:
                group = node.parent.children
                tags: dict[str, int] = {}
                for other in group:
                    tags[other.tag] = tags.get(other.tag, 0) + 1
                lot[key] = (tags, sum(o.chars for o in group), {id(o): j for j, o in enumerate(group)})
            tags, chars, order = lot[key]
            siblings = len(order) - 1
            place = order[id(node)] / max(1, siblings)
            same = (tags[node.tag] - 1) / max(1, siblings)
            around = (chars - node.chars) / max(1, siblings)
        out[i] = (
            node.tag in HEADINGS, node.tag in ("p", "pre", "blockquote"), node.tag in ("li", "dt", "dd"),
            node.tag in ("table", "tr", "td", "th", "tbody"), node.tag in ("div", "section", "center"), bad_tag, good_tag, bad, good,
            over_bad + bad_tag + (bad > 0), over_good + good_tag + (good > 0), hidden, node.depth, node.own, node.chars,
            min(1.0, node.linked / node.own) if node.own else 0.0, node.links / node.chars if node.chars else 0.0,
            node.tags / max(1, node.chars), len(node.children), place, siblings, same, around, node.chars / total,
            node.stops / max(1, node.chars),
        )
    return out


class Trees:
    """Boosted trees as arrays, evaluated for many nodes at once."""

    def __init__(self, model):
        self.trees = []
        for tree, weight in zip(model.trees, model.treeWeights):
            feature, cut, low, high, value = [], [], [], [], []

            def walk(node) -> int:
                own = len(value)
                for values, start in ((feature, -1), (cut, 0.0), (low, -1), (high, -1)):
                    values.append(start)
                value.append(node.prediction())
                if node.subtreeDepth() > 0:
                    feature[own], cut[own] = node.split().featureIndex(), node.split().threshold()
                    low[own], high[own] = walk(node.leftChild()), walk(node.rightChild())
                return own

            walk(tree._call_java("rootNode"))
            self.trees.append((weight, *map(np.array, (feature, cut, low, high, value))))

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros(len(features))
        for weight, feature, cut, low, high, value in self.trees:
            at = np.zeros(len(features), int)
            for _ in range(DEPTH + 1):
                inner = feature[at] >= 0
                left = features[np.arange(len(at)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(left, low[at], high[at]), at)
            total += weight * value[at]
        return 2 * total  # the margin of Spark's logistic loss


def plain_log_odds(features: np.ndarray) -> np.ndarray:
    """For a table that no trees can be fitted on: furniture is out, the rest is in."""
    column = FEATURES.index
    out = (features[:, column("furniture_above")] > 0) | (features[:, column("hidden")] > 0)
    return np.where(out, -4.0, 1.0)


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The most probable labels in which every content node's parent is content."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    place = {id(n): i for i, n in enumerate(nodes)}
    gain, all_no = yes.copy(), no.copy()
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].parent:
            up = place[id(nodes[i].parent)]
            gain[up] += max(gain[i], all_no[i])
            all_no[up] += all_no[i]
    chosen = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        if gain[i] > all_no[i]:
            chosen[i] = node.parent is None or chosen[place[id(node.parent)]]
    return chosen


def main_texts(pages: list[str | None], odds) -> list[str]:
    """The main text of each page; the trees see the nodes of all pages at once."""
    parsed = [parse(page or "") for page in pages]
    parsed = [nodes if nodes[0].chars else [] for nodes in parsed]
    features = [node_features(nodes) for nodes in parsed if nodes]
    every = odds(np.concatenate(features)) if features else np.empty(0)
    texts, at = [], 0
    for nodes in parsed:
        chosen = decode(nodes, every[at : at + len(nodes)]) if nodes else ()
        at += len(nodes)
        runs = sorted(run for node, keep in zip(nodes, chosen) if keep for run in node.runs)
        texts.append(" ".join(text for _, text in runs))
    return texts


def run_labels(nodes: list[Node], document: str | None) -> list[tuple[Node, str, bool]]:
    """Every run with whether it is article text."""
    lines = {" ".join(line.split()) for line in (document or "").split("\n")} - {""}
    starts = {line[:20] for line in lines}
    found, any_line = [], False
    for node in nodes:
        inside = any(up.tag in ARTICLE for up in _path(node))
        for _, text in node.runs:
            whole = text in lines or len(text) >= 20 and text[:20] in starts and any(line.startswith(text) for line in lines)
            any_line |= whole
            found.append((node, text, whole, inside))
    return [(node, text, whole if any_line else inside) for node, text, whole, inside in found]


def _path(node: Node | None):
    while node:
        yield node
        node = node.parent


def node_labels(nodes: list[Node], content_runs: list[tuple[Node, str, bool]]) -> np.ndarray:
    """1 content, 0 boilerplate, -1 without text; a parent of content is content."""
    label = {id(n): -1 for n in nodes}
    for node, _, content in content_runs:
        for up in _path(node):
            label[id(up)] = max(label[id(up)], int(content))
    return np.array([label[id(n)] for n in nodes])


def layout(content: list[tuple[str, str]], furniture: list[str], choose: random.Random) -> tuple[str, set[str]]:
    """A page that shows the texts in another layout, and its article texts.

    A furniture text can stand before, inside or after the article's element."""
    def classes(words: frozenset) -> str:
        return f'{choose.choice(("class", "id"))}="{choose.choice(("", "site-", "page_", "js "))}{choose.choice(sorted(words))}"'

    def boilerplate() -> str:
        text = references.escape(" ".join(choose.sample(furniture, min(len(furniture), choose.randint(1, 3)))))
        body = choose.choice(("{}", "<p>{}</p>", "<div><p>{}</p></div>", '<ul><li><a href="#">{}</a></li></ul>', "<span>{}</span>"))
        tag = choose.choice(("nav", "footer", "header", "aside", "form", "div", "div", "div", "section", "section", "ul"))
        marked = tag in ("div", "section", "ul") or choose.random() < 0.3
        return f"<{tag}{' ' + classes(FURNITURE_WORDS) if marked else ''}>{body.format(text)}</{tag}>"

    tag = choose.choice(("article", "main", "div", "div", "section"))
    marked = tag == "div" and choose.random() < 0.7
    inner = []
    for kind, text in content:
        inner.append(f"<{kind}>{references.escape(text)}</{kind}>")
        if choose.random() < 1.5 / max(3, len(content)):
            inner.append(boilerplate())
    body = f"<{tag}{' ' + classes(ARTICLE_WORDS) if marked else ''}>{''.join(inner)}</{tag}>"
    if choose.random() < 0.4:
        body = f'<div class="{choose.choice(("wrapper", "container", "page", "row"))}">{body}{boilerplate()}</div>'
    before = "".join(boilerplate() for _ in range(choose.randint(0, 3)))
    after = "".join(boilerplate() for _ in range(choose.randint(0, 3)))
    return f"<html><body>{before}{body}{after}</body></html>", {text for _, text in content}


def training_rows(key: int, page: str, document: str | None, layouts: int = LAYOUTS) -> list[tuple[list[float], float]]:
    """Features and label of the nodes of a page and of its other layouts."""
    nodes = parse(page)
    runs = run_labels(nodes, document)
    todo = [(nodes, node_labels(nodes, runs))]
    content = [("h1" if node.tag in HEADINGS else "p", text) for node, text, good in runs if good]
    furniture = [text for _, text, good in runs if not good]
    choose = random.Random(key)
    if content and furniture:
        for _ in range(layouts):
            other, texts = layout(content, furniture, choose)
            made = parse(other)
            todo.append((made, node_labels(made, [(n, t, t in texts) for n in made for _, t in n.runs])))
    return [(row.tolist(), float(label)) for made, labels in todo for row, label in zip(node_features(made), labels) if label >= 0]


def fit(pages: DataFrame, documents: DataFrame | None, document_number: Column, id_col: str = "page_id", html_col: str = "html",
        sample_pages: int = SAMPLE_PAGES):
    """The log-odds function of trees fitted on at most about ``sample_pages`` pages, chosen
    by a hash of their id."""
    rows = pages.count()
    share = min(1.0, sample_pages / max(1, rows))
    chosen = unit_hash(F.col(id_col), seed=17) < share
    sample = pages.where(F.col(html_col).isNotNull() & (chosen if share < 1 else F.lit(True))).select(
        F.xxhash64(F.col(id_col)).alias("key"), F.col(html_col).alias("page"), document_number.alias("number"))
    if documents is not None:
        # the sample's size is bounded by its parameter, and so is what it picks of the documents
        wanted = F.broadcast(sample.select(F.col("number").alias("doc_id")).distinct())
        texts = documents.select("doc_id", F.col("text").alias("document")).join(wanted, "doc_id", "left_semi")
        sample = sample.join(texts, F.col("doc_id") == F.col("number"), "left")
    else:
        sample = sample.withColumn("document", F.lit(None).cast("string"))
    sample = sample.select("key", "page", "document").repartition(24, "key")

    def examples(batches):
        for part in slices(batches):
            made = [r for key, page, document in zip(*(c.to_pylist() for c in part.columns))
                    for r in training_rows(key, page, document)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in made], pa.list_(pa.float64())), pa.array([y for _, y in made], pa.float64())],
                ["features", "label"])

    rows = sample.mapInArrow(examples, "features array<double>, label double").persist()
    try:
        labels = {r["label"] for r in rows.select("label").distinct().collect()}
        if labels != {0.0, 1.0}:
            return plain_log_odds
        learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=5, maxBins=64, cacheNodeIds=False)
        model = learner.fit(rows.select(array_to_vector("features").alias("features"), "label"))
        return Trees(model).log_odds
    finally:
        rows.unpersist()


def extracted(pages: DataFrame, documents: DataFrame | None, document_number: Column, id_col: str = "page_id",
              url_col: str = "url", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """id, url, text and n_chars of every page."""
    odds = fit(pages, documents, document_number, id_col, html_col, sample_pages)

    def run(batches):
        for part in slices(batches):
            texts = main_texts(part.column(2).to_pylist(), odds)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_col, url_col, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
