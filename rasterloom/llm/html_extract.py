"""Main text of web pages by a tree-structured graphical model.

A page's HTML becomes a tree: block elements are inner nodes, runs of inline text (the blocks) are leaves. Every node is content or
not. A node's own evidence (tag, words of class, id and role; of a block its length, share of linked text, punctuation) gives its
potential, and each parent-child edge has a 2 x 2 potential that depends on what the two are. A node knows nothing of what is above or
below it: that a paragraph stands in a sidebar, or a header in an article, reaches it by sum-product messages, which go from the leaves
to the root and back. A block is part of the main text if its marginal is over one half. Weights are fitted by gradient ascent on the
conditional likelihood of labelled pages (labelled_pages writes them in several page layouts; train takes any others).

Scripts, styles, comments and the head never become text. Character references are decoded, white space within a block becomes one
space (so does a line break element), blocks are joined by one newline in page order. A null or empty html gives an empty text.
Broken markup is read as browsers do in the main: unknown end tags are ignored, paragraphs, items and cells end where the next one
starts, a page may stop anywhere. Rows with null ids or urls keep them; repeated rows are extracted one by one; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes xmp template svg math object select".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul head frameset".split()
)
CLOSES_P = BLOCKS - {"button", "label", "option", "optgroup", "html", "body", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An element that ends when one of its like starts, and what it can't reach through.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"})}
TAGS = ["article", "main", "section", "div", "p", "heading", "list", "item", "nav", "header", "footer", "aside", "form", "table", "quote", "other"]
_TAG_KIND = {t: TAGS.index(k) for k, names in {"article": "article", "main": "main", "section": "section", "div": "div center", "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl dir", "item": "li dt dd", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset button label legend option dialog", "table": "table tbody thead tfoot tr td th caption", "quote": "blockquote pre figure figcaption"}.items() for t in names.split()}
WORDS = {
    "content": "article|content|post|entry|story|main|text|prose|body",
    "navigation": "nav|navbar|navigation|menu|breadcrumb|breadcrumbs|toc|pagination|pager|skip|links",
    "header": "header|masthead|topbar|logo|branding|banner",
    "footer": "footer|copyright|colophon|legal|imprint",
    "side": "sidebar|side|widget|related|recommended|recommendations|promo|popular|trending|rail|complementary|teaser|more",
    "notice": "cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall|dialog|privacy|announcement",
    "advert": "ad|ads|advert|advertisement|advertising|sponsor|sponsored|adslot|adsense|banner-ad",
    "comment": "comment|comments|disqus|reply|replies|discussion|respond|feedback",
    "social": "share|sharing|social|follow|byline|meta|tags|tag",
}
_WORD_KINDS = list(WORDS)
_WORD_OF = {w: i for i, names in enumerate(WORDS.values()) for w in names.split("|")}
_NOISE = range(1, len(_WORD_KINDS))
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Za-z]+")
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')|=)*+)>?""", re.S)
LEAF = ["leaf", "log_length", "short", "link_share", "ends_sentence", "many_words", "mark"]
UNARY = [f"tag_{t}" for t in TAGS] + [f"word_{w}" for w in _WORD_KINDS] + LEAF + ["top", "bias"]
EDGE = ["any", "noise_child", "content_child", "leaf_child", "landmark_child", "content_parent", "header_in_content"]
_LANDMARKS = {TAGS.index(t) for t in ("nav", "header", "footer", "aside", "form")}
_HEADER = TAGS.index("header")
_CONTAINERS = {TAGS.index(t) for t in ("article", "main")}  # what holds content by its tag
_MARKS = re.compile(r"[©®]")


@dataclass
class Tree:
    """Nodes in page order: parent (-1 at the root), depth, features of the node and of the edge to its parent; texts of the leaves."""

    parent: list[int]
    depth: list[int]
    unary: list[list[float]]
    edge: list[list[float]]
    leaves: list[int]
    texts: list[str]
    gold: list[int]


_attributes: dict[str, tuple[int, ...]] = {}


def _named(attributes: str) -> tuple[int, ...]:
    """The kinds of word in class, id, role and aria-label."""
    if attributes not in _attributes:
        if len(_attributes) > 20_000:
            _attributes.clear()
        parts = {p.lower() for m in _ATTRIBUTE.finditer(attributes) for p in _PART.findall(m[1] or m[2] or m[3] or "")}
        _attributes[attributes] = tuple(sorted({_WORD_OF[p] for p in parts if p in _WORD_OF}))
    return _attributes[attributes]


def parse(page: str | None) -> Tree:
    tree = Tree([], [], [], [], [], [], [])
    names: list[str] = []  # open block elements
    nodes: list[int] = []
    held: dict[str, int] = {}
    run: list[str] = []
    linked = [0, 0]  # depth of open links, linked characters in the run
    golds: list[int] = []
    contents: list[bool] = []  # of the open elements: whether their tag or name says that they hold content

    def holds(kind: int, words: tuple[int, ...]) -> bool:
        return kind in _CONTAINERS or 0 in words and not any(w in _NOISE for w in words)

    def add(kind: int, words: tuple[int, ...], leaf: list[float] | None, gold: int) -> int:
        x = [0.0] * len(UNARY)
        depth = tree.depth[nodes[-1]] + 1 if nodes else 0
        if leaf is None:
            x[kind] = 1.0
            for w in words:
                x[len(TAGS) + w] = 1.0
        else:
            x[len(TAGS) + len(_WORD_KINDS) : len(TAGS) + len(_WORD_KINDS) + len(LEAF)] = leaf
        x[-2], x[-1] = float(depth <= 1), 1.0
        noise, inside = any(w in _NOISE for w in words), bool(contents and contents[-1])
        tree.parent.append(nodes[-1] if nodes else -1)
        tree.depth.append(depth)
        tree.unary.append(x)
        tree.edge.append([1.0, float(noise), float(holds(kind, words)), float(leaf is not None), float(kind in _LANDMARKS), float(inside), float(inside and kind == _HEADER)])
        tree.gold.append(gold)
        return len(tree.parent) - 1

    def flush() -> None:
        if not run:
            return
        raw = "".join(run)
        run.clear()
        text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
        share, linked[1] = min(1.0, linked[1] / max(1, len(raw))), 0
        if text:
            n = len(text)
            leaf = [1.0, min(1.0, np.log1p(n) / 7), float(n < 25), share, float(text[-1] in ".!?…。:;\"”»"), float(n > 120), float(bool(_MARKS.search(text)))]
            tree.leaves.append(add(-1, (), leaf, golds[-1] if golds else 0))
            tree.texts.append(text)

    def open_(name: str, attributes: str) -> None:
        gold = golds[-1] if golds else 0
        if "data-y" in attributes and (m := re.search(r'data-y="([01])"', attributes)):
            gold = int(m[1])
        node = add(_TAG_KIND.get(name, len(TAGS) - 1), _named(attributes) if attributes else (), None, gold)
        names.append(name)
        contents.append(holds(_TAG_KIND.get(name, len(TAGS) - 1), _named(attributes) if attributes else ()))
        nodes.append(node)
        golds.append(gold)
        held[name] = held.get(name, 0) + 1

    def close(count: int) -> None:
        for _ in range(count):
            held[names.pop()] -= 1
            nodes.pop()
            contents.pop()
            golds.pop()

    def close_like(kinds: set[str], stop: set[str]) -> None:
        if any(held.get(k) for k in kinds):
            for back in range(1, len(names) + 1):
                if names[-back] in stop:
                    return
                if names[-back] in kinds:
                    close(back)
                    return close_like(kinds, stop)

    open_("body", "")
    page = page or ""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        start, end = (m.start(), m.end()) if m else (n, n)
        if start > at:
            run.append(page[at:start])
            if linked[0]:
                linked[1] += start - at
        at = end
        if not m or not m[2]:
            continue
        name = m[2].lower()
        if not m[1]:
            if name in RAW or name == "head":
                tail = m[3].rstrip().endswith("/") and name in ("svg", "math")
                if name == "head":
                    # what browsers allow in a head has raw text or none, so reading on takes care of it
                    continue
                if not tail:
                    close_tag = re.compile(rf"</{re.escape(name)}(?![\w-])[^>]*>?", re.I).search(page, at)
                    at = close_tag.end() if close_tag else n
                run.append(" ")
            elif name in ("html", "body"):
                # the root stands for both; what they are named by is evidence about the page, not about a part
                continue
            elif name in BLOCKS:
                flush()
                if name in CLOSES_P and held.get("p"):
                    close_like({"p"}, {"table", "td", "th", "button", "caption"})
                if name in ENDS:
                    close_like(*ENDS[name])
                if name != "hr":
                    open_(name, m[3])
            elif name == "br":
                run.append(" ")
            elif name == "a":
                linked[0] = 1
            elif name == "img":
                run.append(" ")
        elif name == "a":
            linked[0] = 0
        elif name in BLOCKS and name not in ("html", "body", "head"):
            flush()
            if held.get(name):
                close(names[::-1].index(name) + 1)
        elif name == "p":
            flush()
    flush()
    return tree


@dataclass
class Forest:
    """Trees of several pages side by side, in arrays; order lists the nodes of each depth."""

    parent: np.ndarray
    unary: np.ndarray
    edge: np.ndarray
    levels: list[np.ndarray]
    leaves: list[np.ndarray]

    @classmethod
    def of(cls, trees: list[Tree]) -> Forest:
        sizes = [len(t.parent) for t in trees]
        offsets = np.cumsum([0, *sizes])
        parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + o) for t, o in zip(trees, offsets, strict=False)])
        depth = np.concatenate([np.array(t.depth) for t in trees])
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        return cls(parent, np.array([x for t in trees for x in t.unary]), np.array([x for t in trees for x in t.edge]), levels, [np.array(t.leaves, np.int64) + o for t, o in zip(trees, offsets, strict=False)])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Over the two labels."""
    return np.logaddexp(*np.moveaxis(x, axis, 0))


@dataclass
class Model:
    unary: np.ndarray  # weight of each feature for being content
    edge: np.ndarray  # for each edge feature, a potential of (parent, child)

    def messages(self, f: Forest):
        """Sum-product: marginals of all nodes, and for every edge the joint marginal with its parent."""
        n = len(f.parent)
        pair = np.tensordot(f.edge, self.edge, 1)  # node, parent's label, own label
        below = np.zeros((n, 2))
        below[:, 1] = f.unary @ self.unary
        up = np.zeros((n, 2))
        for level in f.levels[:0:-1]:
            up[level] = _log_sum(pair[level] + below[level][:, None, :], 2)
            np.add.at(below, f.parent[level], up[level])
        total = below.copy()
        rest = np.zeros((n, 2))
        for level in f.levels[1:]:
            rest[level] = total[f.parent[level]] - up[level]
            total[level] = below[level] + _log_sum(pair[level] + rest[level][:, :, None], 1)
        marginal = np.exp(total[:, 1] - _log_sum(total, 1))
        joint = pair + rest[:, :, None] + below[:, None, :]
        joint = np.exp(joint - _log_sum(_log_sum(joint, 2), 1)[:, None, None])
        return marginal, joint

    def texts(self, trees: list[Tree]) -> list[str]:
        f = Forest.of(trees)
        marginal, _ = self.messages(f)
        return ["\n".join(x for x, m in zip(t.texts, marginal[own] > 0.5, strict=True) if m) for t, own in zip(trees, f.leaves, strict=True)]


def train(pages: list[str], steps: int = 200, rate: float = 0.1, hold: float = 3e-4, edges: bool = True) -> Model:
    """Fits the model to pages whose elements carry data-y="1" (content) or "0"; an inner node counts as content if a block below it does.
    edges: False leaves the edges' potentials at 0, for comparison."""
    trees = [parse(p) for p in pages]
    for t in trees:
        own = set(t.leaves)
        t.gold = [g if i in own else 0 for i, g in enumerate(t.gold)]
        for i in range(len(t.parent) - 1, 0, -1):  # children come after their parent
            t.gold[t.parent[i]] |= t.gold[i]
    f = Forest.of(trees)
    y = np.array([g for t in trees for g in t.gold])
    inner = f.parent >= 0
    seen = np.zeros((len(y), 2, 2))
    seen[np.flatnonzero(inner), y[f.parent[inner]], y[inner]] = 1
    model = Model(np.zeros(len(UNARY)), np.zeros((len(EDGE), 2, 2)))
    flat = np.zeros(len(UNARY) + 4 * len(EDGE))
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for k in range(1, steps + 1):
        marginal, joint = model.messages(f)
        grad = np.concatenate((f.unary.T @ (y - marginal), np.tensordot(f.edge[inner], (seen - joint)[inner], ((0,), (0,))).ravel())) / len(pages) - hold * flat
        grad[len(UNARY) :] *= edges
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        flat = flat + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        model = Model(flat[: len(UNARY)], flat[len(UNARY) :].reshape(-1, 2, 2))
    return model


def labelled_pages(count: int = 360, seed: int = 7) -> list[str]:
    """Pages in several layouts whose elements are labelled; words are invented, so only structure and shape tell."""
    r = random.Random(seed)
    pick, chance = r.choice, lambda p: r.random() < p

    def words(a: int, b: int) -> str:
        return " ".join("".join(pick(("ba", "ne", "ti", "ro", "lu", "sha", "an", "er", "éa", "um")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))

    tone = ["plain"]  # of the article being written: what it says may look like anything

    def sentence(a: int = 5, b: int = 25) -> str:
        text = words(1, 3) if tone[0] == "terse" else words(a, b)
        if tone[0] == "pipes":
            return text.replace(" ", " | ") + pick(("", " |"))
        if tone[0] == "caps":
            return text.upper().replace(" ", "!! ") + "!!"
        if tone[0] == "junk":
            return "".join(w + pick(("###", "$$$", "***", " ")) + " " for w in text.split())
        if tone[0] == "bare":
            return text
        return text.capitalize() + pick("...!?")

    def prose(a: int = 1, b: int = 7) -> str:
        return " ".join(sentence() if chance(0.9) else pick(("<b>{}</b>", '<a href="/x">{}</a>', "<em>{}</em> ")).format(words(1, 4)) + "." for _ in range(r.randint(a, b)))

    def links(a: int, b: int) -> str:
        return pick(("<ul>{}</ul>", "{}")).format("".join((f'<li><a href="/{k}">{words(1, 4)}</a></li>' if chance(0.8) else f'<a href="/{k}">{words(1, 3)}</a> ') for k in range(r.randint(a, b))))

    def block(tags: str, named: str, body: str) -> str:
        """A part that isn't content: by its tag, by its name, or by both."""
        tag, name = pick(tags.split()), pick(named.split())
        by = f' {pick(("class", "id", "class"))}="{pick(("", "site-", "page-", "js-"))}{name}{pick(("", "-box", " wide", "-1"))}"' if tag in ("div", "section") or chance(0.5) else ""
        return f'<{tag}{by} data-y="0">{body}</{tag}>'

    def article(noise: bool = True) -> str:
        tiny, lists = chance(0.15), chance(0.12)
        out = [f"<h1>{words(2, 12).capitalize()}</h1>" if chance(0.3 if tiny else 0.85) else ""]
        for _ in range(1 if tiny else r.randint(1, 12) if chance(0.8) else r.randint(20, 70)):
            kind = 0.8 if lists and chance(0.7) else r.random()
            if kind < 0.6:
                out.append(f"<p>{prose()}" + ("</p>" if chance(0.8) else ""))
            elif kind < 0.72:
                out.append(f"<p>{sentence(1, 3)}</p>")
            elif kind < 0.78:
                out.append(f"<h{(k := pick('23'))}>{words(1, 6).capitalize()}</h{k}>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{sentence(2, 14)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{prose(1, 3)}</p></blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 5)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.94:
                out.append(f"<figure><img src=x><figcaption>{sentence(3, 12)}</figcaption></figure>")
            elif kind < 0.97:
                out.append(f"<div>{prose(1, 4)}</div>")
            else:
                out.append(f"<p><b>{prose(1, 3)}<br><p>{prose(1, 3)}")
            if noise and chance(0.06):
                out.append(pick((advert, share, related))())
        return "".join(out)

    def menu() -> str:
        return block("nav nav div", "menu nav navbar navigation breadcrumb", links(3, 9))

    def advert() -> str:
        return block("div div aside section", "ad ads advert advertisement sponsored", pick((sentence(), prose(1, 3), links(1, 2))))

    def share() -> str:
        return block("div", "share social follow", links(2, 5))

    def related() -> str:
        return block("aside aside div section", "sidebar related widget promo popular recommended", pick(("", f"<h3>{words(1, 3)}</h3>")) + pick((links(2, 7), f"<p>{prose(1, 2)}</p>")))

    def notice() -> str:
        return block("div section dialog", "cookie consent notice newsletter popup alert gdpr", f"<p>{sentence(6, 20)}</p>" + pick(("", f"<button>{words(1, 2)}</button>")))

    def form() -> str:
        return f'<form action="/s" data-y="0"><label>{words(1, 4)}</label><input name=q>{pick(("", f"<p>{sentence(4, 12)}</p>"))}<button>{words(1, 2)}</button></form>'

    def comments() -> str:
        each = "".join(pick((f'<div class="comment"><b>{words(1, 2)}</b><p>{prose(1, 3)}</p></div>', f"<li>{prose(1, 2)}</li>", f"<p>{prose(1, 2)}</p>", f"<article class=comment><p>{prose(1, 2)}</p></article>")) for _ in range(r.randint(1, 5)))
        return block("section div div ol", "comments comment replies discussion disqus", f"<h2>{words(1, 2)}</h2>" + each)

    def head() -> str:
        return block("header header div", "header masthead topbar logo", pick((f"<p>{words(2, 8)}</p>", f'<a href="/">{words(1, 3)}</a>', f"<h1>{words(1, 3)}</h1><p>{sentence(3, 9)}</p>", f"<div>{words(1, 5)}</div>" + links(2, 5))))

    def foot() -> str:
        body = pick((f"&copy; {words(1, 3)} &middot; {sentence(4, 16)}", f"<p>{sentence(4, 16)}</p>" + links(2, 5), f"<p>{prose(1, 3)}</p>"))
        return block("footer footer div", "footer copyright legal", body)

    out = []
    for _ in range(count):
        tone[0] = pick(("plain", "plain", "plain", "plain", "pipes", "caps", "junk", "bare", "terse", "terse"))
        wrap = r.random()
        text = article(wrap >= 0.06)
        tone[0] = "plain"
        if wrap < 0.06:  # right in the body
            core = re.sub(r"<(p|h[1-6]|ul|li|blockquote|table|tr|td|figure|figcaption|div)(?=[ >])", r'<\1 data-y="1"', text)
        elif wrap < 0.45:
            core = f'<article data-y="1">{pick(("", "<header>{}</header>".format(f"<h1>{words(2, 8)}</h1>"))) if chance(0.3) else ""}{text}</article>'
        elif wrap < 0.6:
            core = f'<main data-y="1">{text}</main>'
        elif wrap < 0.9:
            core = f'<div {pick(("class", "id"))}="{pick(("content", "article-body", "post", "entry-content", "story", "main-text"))}" data-y="1">{text}</div>'
        else:
            core = f'<div data-y="1">{text}</div>'
        if wrap >= 0.06 and chance(0.25):
            core = f'<{(t := pick(("main", "div", "section")))}>{core}{related() if chance(0.4) else ""}</{t}>'
        bare = chance(0.08)
        before = [f() for f, p in ((head, 0.5), (menu, 0.8), (notice, 0.3), (advert, 0.5), (form, 0.15), (share, 0.1)) if chance(p) and not bare]
        after = [f() for f, p in ((share, 0.2), (related, 0.4), (comments, 0.35), (advert, 0.2), (form, 0.25), (notice, 0.15), (foot, 0.8)) if chance(p) and not bare]
        if chance(0.3):
            r.shuffle(before)
        page = f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title><style>p{{}}</style></head><body>{''.join(before)}{core}{''.join(after)}"
        out.append(page + "</body></html>" if chance(0.8) else page[: len(page) - r.randint(0, 12)])
    return out


_trained: dict[str, Model] = {}


def default_model() -> Model:
    if "model" not in _trained:
        _trained["model"] = train(labelled_pages())
    return _trained["model"]


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, held, size = [], [], 0
        for page in batch.column(2):
            held.append(parse(page.as_py()))
            size += len(held[-1].parent)
            if size > 20_000:
                texts += model.texts(held)
                held, size = [], 0
        if held:
            texts += model.texts(held)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_TEXT)


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row. No shuffle."""
    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(partial(_extract, model or default_model()), "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return main_text(table(spark, sf_dir, "pages"))
