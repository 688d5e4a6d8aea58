"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is scanned into leaf blocks: runs of text between block-level tags, with the tags and the class, id and role words of their
ancestors. Each block gets features (ancestors, words of their attributes, own tag, length, link share, punctuation,
place); a linear-chain CRF with two labels scores them, with transitions that know whether two blocks share their
parent, and Viterbi's algorithm picks the labels. Blocks labelled content, joined in page order by newlines, are the text.

The CRF is trained here on labelled pages that `labelled_pages` writes: layouts with and without semantic tags, whose every
block is known to be content or not. Training is deterministic and doesn't read the table.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow

# Kinds of HTML elements, as the HTML standard has them. RAW hold text alone, up to their end tag; what is in SKIPPED isn't shown as text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
SKIPPED = frozenset("noscript template svg math object canvas select audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label link mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the key closes an open element of the value, up to one of SCOPE.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table tbody thead tfoot article section main body div nav aside form td th".split())
NOT_IN_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: No skipped element holds these: a start tag of one ends those that were left open.
NOT_SKIPPED = frozenset("article main h1".split())

tag_name = re.compile(r"[a-zA-Z][^\s/>]*")
END_OF = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW}
quote_or_end = re.compile("[\"'>]").search
attribute = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
name_parts = re.compile(r"[a-z]+").findall

# Words of class names and ids by what they speak for: this operator's own choice of features.
FAMILIES = {
    "ad": "ad ads adv advert advertisement advertising adslot adsense banner dfp promo promoted promotion sponsor sponsored commercial",
    "notice": "alert consent cookie cookies gdpr modal newsletter notice notification overlay paywall popup privacy signup subscribe subscription toast",
    "comment": "comment comments commentlist discussion disqus feedback replies reply respond responses thread",
    "nav": "breadcrumb breadcrumbs crumb dropdown menu menubar nav navbar navigation pager pagination paging skip tabs toc topbar",
    "side": "aside complementary rail recommend recommended recommendations related sidebar similar teaser trending widget widgets popular latest more",
    "social": "bookmark follow share sharing social tweet",
    "foot": "bottom colophon contentinfo copyright credits foot footer imprint legal",
    "head": "brand header logo masthead site title tagline top hero",
    "form": "contact field form input login register search",
    "meta": "author byline date meta tags timestamp category",
    "body": "article articlebody body content entry main post prose story text copy single",
}
FAMILY = {w: f for f, words in FAMILIES.items() for w in words.split()}


@dataclass
class Block:
    text: str
    tags: frozenset[str]
    own: str
    families: frozenset[str]
    linked: int
    parent: int


def tags_of(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of every tag; comments and declarations have the name "". A > inside quotes ends no tag, unless a quote is left open.

    After the start tag of a RAW element comes its end tag. Takes time in proportion to the page: what a scan for closing quotes ran into in vain is remembered.
    """
    at, vain = 0, set()
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        near = html.find(">", start)
        if near < 0:  # no tag ends any more
            at = html.find("<!--", start)
            if at < 0:
                return
            continue
        if html[start + 1] in "!?":
            at = near + 1
            yield start, at, "", False, ""
            continue
        closing = html[start + 1] == "/"
        name = tag_name.match(html, start + 1 + closing, near)
        if not name:
            at = start + 1
            continue
        end, k, opened = near, name.end(), []
        while found := quote_or_end(html, k):
            k = found.start()
            if html[k] == ">":
                end = k
                break
            opened.append(k)
            close = -1 if k in vain else html.find(html[k], k + 1)
            if close < 0:
                vain.update(opened)
                break
            k = close + 1
        else:
            vain.update(opened)
        at = end + 1
        yield start, at, (low := name[0].lower()), closing, html[name.end() : end]
        if low in RAW and not closing:
            found = END_OF[low].search(html, at)
            at = found.start() if found else len(html)


@dataclass(slots=True)
class Open:
    """An open element with what holds for all around it too: families, kinds of ancestors, the innermost block-level element and its parent."""

    name: str
    families: frozenset[str]
    tags: frozenset[str]
    own: str
    number: int
    parent: int


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    html = html or ""
    root = Open("", frozenset(), frozenset(), "", -1, -1)
    stack: list[Open] = [root]
    places: dict[str, list[int]] = {}  # where elements of a name lie in the stack
    solid: list[int] = [0]  # where those that aren't inline do
    out: list[Block] = []
    parts: list[str] = []
    linked, links, hidden, count, at, raw = 0, 0, 0, 0, 0, ""

    def flush() -> None:
        nonlocal linked
        held = "".join(parts)
        parts.clear()
        if held:
            text = " ".join((unescape(held) if "&" in held else held).split())
            if text:
                top = stack[-1]
                out.append(Block(text, top.tags, top.own, top.families, min(linked, len(text)), top.parent))
        linked = 0

    def last(*names: str) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def drop(to: int) -> None:
        nonlocal links, hidden
        while len(stack) > to:
            gone = stack.pop().name
            places[gone].pop()
            links -= gone == "a"
            hidden -= gone in SKIPPED
            if solid[-1] == len(stack):
                solid.pop()

    for start, end, name, closing, attributes in tags_of(html):
        if raw:
            at, raw = end, ""
            continue
        if start > at and not hidden:
            piece = html[at:start]
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        at = end
        if not name:
            continue
        if name in INLINE:
            if name in ("br", "wbr", "img", "input"):
                parts.append(" " if name == "br" else "")
                continue
        elif not hidden and (name not in RAW and name not in SKIPPED or name == "title"):
            flush()
        if closing:
            k = last(name)
            if k and (name not in INLINE or k > solid[-1]):
                drop(k)
            continue
        if name in RAW:
            raw = name
            continue
        if name in VOID or name in SKIPPED and attributes.rstrip().endswith("/"):
            continue
        if name in NOT_SKIPPED and hidden:
            drop(min(places[x][0] for x in SKIPPED if places.get(x)))
            flush()
        if name in NOT_IN_P:
            if (k := last("p")) > last(*SCOPE):
                drop(k)
        elif name in CLOSES:
            if name == "tr":
                within = last(*(SCOPE - {"td", "th"}))
                if (k := min((x for n in CLOSES[name] for x in places.get(n, ()) if x > within), default=0)):
                    drop(k)
            elif (k := last(*CLOSES[name])) and k >= last(*SCOPE):
                drop(k)
        top = stack[-1]
        families = top.families.union(FAMILY[w] for v in attribute.findall(attributes) for w in name_parts(v.lower()) if w in FAMILY) if attributes else top.families
        tags = top.tags if name in top.tags or name not in KINDS else top.tags | {name}
        count += 1
        links += name == "a"
        hidden += name in SKIPPED
        if name in INLINE or name in SKIPPED:
            stack.append(Open(name, families, tags, top.own, top.number, top.parent))
        else:
            solid.append(len(stack))
            stack.append(Open(name, families, tags, name, count, top.number))
        places.setdefault(name, []).append(len(stack) - 1)
    if not raw and not hidden and at < len(html):
        parts.append(html[at:])
    flush()
    return out


def bucket(n: int) -> int:
    return min(n.bit_length(), 8)


ANCESTORS = ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "section", "figure", "figcaption", "blockquote", "pre", "button", "label", "dialog", "address", "a", "dl", "fieldset", "details", "menu")
KINDS = frozenset(ANCESTORS)


def features(found: list[Block]) -> list[list[str]]:
    """Names of each block's features."""
    out, seen_heading = [], False
    has_article = any("article" in b.tags or "main" in b.tags for b in found)
    for k, b in enumerate(found):
        tags, own = b.tags, b.own
        n = b.text.count(" ") + 1
        inside = "article" in tags or "main" in tags
        f = ["bias", f"own={own}", f"words={bucket(n)}", f"links={4 * b.linked // len(b.text)}", f"end={b.text[-1] in '.!?…:;。'}", f"heading={seen_heading}", f"inside={inside if has_article else 'none'}"]
        f += [f"in={t}" for t in ANCESTORS if t in tags]
        f += [f"family={x}" for x in b.families]
        if any(c in b.text for c in "©®") or "copyright" in b.text.lower():
            f.append("rights")
        if k == 0:
            f.append("first")
        if k == len(found) - 1:
            f.append("final")
        seen_heading = seen_heading or own == "h1"
        out.append(f)
    return out


@dataclass(frozen=True)
class Crf:
    """Weights of a feature for content against the rest, and transitions [same parent][from][to]."""

    weights: dict[str, float]
    transitions: tuple

    def label(self, found: list[Block]) -> list[bool]:
        """Viterbi's labels."""
        if not found:
            return []
        back, score = [], [0.0, 0.0]
        for k, f in enumerate(features(found)):
            gain = sum(map(lambda x: self.weights.get(x, 0.0), f))
            if k == 0:
                score = [0.0, gain]
                continue
            t = self.transitions[found[k].parent == found[k - 1].parent]
            step = [max((score[i] + t[i][j], i) for i in (0, 1)) for j in (0, 1)]
            back.append((step[0][1], step[1][1]))
            score = [step[0][0], step[1][0] + gain]
        at = int(score[1] > score[0])
        labels = [at]
        for b in reversed(back):
            at = b[at]
            labels.append(at)
        return [bool(x) for x in reversed(labels)]


def train(pages: list[tuple[str, list[bool]]], rounds: int = 150, rate: float = 0.15, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by gradient steps (Adam), forward and backward over all pages together."""
    sequences, labels = [], []
    for html, wanted in pages:
        found = blocks(html)
        if len(found) != len(wanted):
            raise ValueError("a labelled page must have a label for each block")
        sequences.append((features(found), [k > 0 and found[k].parent == found[k - 1].parent for k in range(len(found))]))
        labels.append(wanted)
    names = sorted({x for f, _ in sequences for row in f for x in row})
    number = {x: k for k, x in enumerate(names)}
    n, longest = len(sequences), max(len(f) for f, _ in sequences)
    at = [(s, t, number[x]) for s, (f, _) in enumerate(sequences) for t, row in enumerate(f) for x in row]
    s_i, t_i, f_i = (np.array(c) for c in zip(*at, strict=True))
    valid, same, y = np.zeros((n, longest), bool), np.zeros((n, longest), int), np.zeros((n, longest), int)
    for s, ((f, parents), wanted) in enumerate(zip(sequences, labels, strict=True)):
        valid[s, : len(f)], same[s, : len(f)], y[s, : len(f)] = True, parents, wanted
    w, trans = np.zeros(len(names)), np.zeros((2, 2, 2))
    state = [np.zeros(len(names)), np.zeros(len(names)), np.zeros((2, 2, 2)), np.zeros((2, 2, 2))]
    for step in range(1, rounds + 1):
        gain = np.zeros((n, longest))
        np.add.at(gain, (s_i, t_i), w[f_i])
        emit = np.stack([np.zeros_like(gain), gain], -1)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(alpha[:, t - 1, 0, None] + trans[same[:, t], 0], alpha[:, t - 1, 1, None] + trans[same[:, t], 1]) + emit[:, t]
            alpha[:, t] = np.where(valid[:, t, None], new, alpha[:, t - 1])
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            ahead = emit[:, t + 1] + beta[:, t + 1]
            new = np.stack([np.logaddexp(trans[same[:, t + 1], i, 0] + ahead[:, 0], trans[same[:, t + 1], i, 1] + ahead[:, 1]) for i in (0, 1)], -1)
            beta[:, t] = np.where(valid[:, t + 1, None], new, 0.0)
        p = np.exp(alpha + beta - total[:, None, None])[:, :, 1]
        residual = np.where(valid, y - p, 0.0)
        g = np.bincount(f_i, residual[s_i, t_i], len(names)) / n - ridge * w
        gt = np.zeros_like(trans)
        for t in range(1, longest):
            on = valid[:, t]
            pair = np.exp(alpha[:, t - 1, :, None] + trans[same[:, t]] + (emit[:, t] + beta[:, t])[:, None, :] - total[:, None, None])
            np.add.at(gt, same[on, t], -pair[on])
            np.add.at(gt, (same[on, t], y[on, t - 1], y[on, t]), 1.0)
        gt = gt / n - ridge * trans
        for param, grad, a, b in ((w, g, 0, 1), (trans, gt, 2, 3)):
            state[a] = 0.9 * state[a] + 0.1 * grad
            state[b] = 0.999 * state[b] + 0.001 * grad**2
            param += rate * (state[a] / (1 - 0.9**step)) / (np.sqrt(state[b] / (1 - 0.999**step)) + 1e-8)
    return Crf({x: float(w[k]) for x, k in number.items() if abs(w[k]) > 1e-6}, tuple(tuple(tuple(map(float, r)) for r in m) for m in trans))


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[bool]]]:
    """n pages of varied layout with the label of every block: True for the article's own text."""
    r = random.Random(seed)

    def sentence(low: int = 2, high: int = 18) -> str:
        words = ["".join(r.choice("aeiourstlnmd") for _ in range(r.randint(2, 8))) for _ in range(r.randint(low, high))]
        return " ".join(words).capitalize() + r.choice([".", ".", ".", "?", "!", ""])

    def text(low: int = 1, high: int = 6) -> str:
        return escape(" ".join(sentence() for _ in range(r.randint(low, high))))

    def page() -> tuple[str, list[bool]]:
        out, labels = [], []

        def put(html: str, *wanted: bool) -> None:
            out.append(html)
            labels.extend(wanted)

        def links(k: int, tag: str = "li") -> str:
            return "".join(f'<{tag}><a href="/{j}">{escape(sentence(1, 3)[:-1] or "x")}</a></{tag}>' for j in range(k))

        def attrs(*names: str) -> str:
            return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'

        def noise(kind: str) -> None:
            k = r.randint(1, 7)
            if kind == "nav":
                opened = r.choice(["<nav>", f"<div{attrs('menu', 'nav', 'navbar', 'main-menu', 'breadcrumb', 'pagination')}>", f"<nav{attrs('top', 'main')}>"])
                put(f"{opened}<ul>{links(k)}</ul></{opened[1:].split('>')[0].split()[0]}>", *[False] * k)
            elif kind == "header":
                if r.random() < 0.5:
                    put(f"<header><h1>{text(1, 1)}</h1><p>{text(1, 1)}</p></header>", False, False)
                else:
                    put(f"<div{attrs('header', 'masthead', 'site-header', 'logo')}><a href='/'>{text(1, 1)}</a></div>", False)
            elif kind == "ad":
                tag = r.choice(["div", "aside", "section", "p"])
                put(f"<{tag}{attrs('ad', 'ads', 'advert', 'sponsored', 'ad-banner', 'promo')}>{text(1, 3)}</{tag}>", False)
            elif kind == "aside":
                opened = r.choice(["<aside>", f"<div{attrs('sidebar', 'widget', 'related', 'recommended')}>"])
                put(f"{opened}<h3>{text(1, 1)}</h3><p>{text(1, 3)}</p><ul>{links(k)}</ul></{opened[1:].split('>')[0].split()[0]}>", False, False, *[False] * k)
            elif kind == "notice":
                put(f"<div{attrs('cookie', 'cookie-notice', 'consent', 'alert', 'newsletter', 'popup', 'notice')}><p>{text(1, 3)}</p><button>{sentence(1, 2)}</button></div>", False, False)
            elif kind == "form":
                put(f"<form action='/s'><label>{text(1, 1)}</label><input name='q'><p>{text(1, 2)}</p><button>{sentence(1, 2)}</button></form>", False, False, False)
            elif kind == "comments":
                opened = r.choice(["<section", "<div", "<ol", "<ul"]) + attrs("comments", "comment-list", "discussion", "replies", "disqus")
                tag = opened[1:].split()[0]
                item = "li" if tag in ("ol", "ul") else r.choice(["div", "p", "article"])
                put(f"{opened}>" + "".join(f"<{item} class='comment'>{text(1, 4)}</{item}>" for _ in range(k)) + f"</{tag}>", *[False] * k)
            elif kind == "footer":
                opened = r.choice(["<footer>", f"<div{attrs('footer', 'site-footer', 'copyright', 'legal')}>"])
                put(f"{opened}{r.choice(['&copy; ', ''])}{text(1, 2)}</{opened[1:].split('>')[0].split()[0]}>", False)
            elif kind == "social":
                put(f"<div{attrs('share', 'social', 'share-buttons')}><a href='#'>{sentence(1, 2)}</a></div>", False)

        put(f"<!DOCTYPE html><html><head><title>{text(1, 1)}</title><style>p{{margin:0}}</style><script>var a='<p>x</p>';</script></head><body>")
        for kind in r.sample(["nav", "header", "ad", "notice", "form", "aside"], r.choice([0, 0, 1, 2, 3, 4])):
            noise(kind)
        opened = r.choice(["<article>", "<article>", "<article>", "<main>", "<main><article>", f"<div{attrs('content', 'article', 'post', 'entry-content', 'main', 'story-body', 'article-body')}>", "<div>"])
        put(opened)
        if r.random() < 0.85:
            put(f"<h1>{text(1, 1)}</h1>", True)
        for k in range(r.choice([1, 1, *range(1, 13)])):
            what = r.random()
            if k and what < 0.06:
                noise(r.choice(["ad", "ad", "aside", "social", "form", "notice", "nav"]))
            elif what < 0.12:
                j = r.randint(1, 4)
                put(f"<{r.choice(['ul', 'ol'])}>" + "".join(f"<li>{text(1, 2)}</li>" for _ in range(j)) + "</ul>", *[True] * j)
            elif what < 0.18:
                h = r.choice(["h2", "h2", "h3", "h4"])
                put(f"<{h}>{text(1, 1)}</{h}>", True)
            elif what < 0.24:
                put(f"<blockquote>{text(1, 3)}</blockquote>", True)
            elif what < 0.27:
                put(f"<pre>{text(1, 3)}</pre>", True)
            elif what < 0.30:
                put(f"<table><tr><td>{text(1, 1)}</td><td>{text(1, 1)}</td></tr></table>", True, True)
            elif what < 0.36:
                put(f"<p><a href='/x'>{text(1, 1)}</a> {text(1, 2)}</p>", True)
            elif what < 0.39:
                put(f"<section><h3>{text(1, 1)}</h3><p>{text(1, 5)}</p></section>", True, True)
            elif what < 0.42:
                put(f"<div>{text(1, 5)}</div>", True)
            elif what < 0.50:
                put(f"<p>{escape(sentence(1, 2))}</p>", True)
            elif what < 0.6:
                put(f"<p><b>{text(1, 2)}<br>", True)
                put(f"<p>{text(1, 6)}</p>", True)
            else:
                put(f"<p>{text(1, 8)}</p>", True)
        tags = re.findall(r"<(\w+)", opened)
        if r.random() < 0.15:
            noise("comments")
        put("".join(f"</{t}>" for t in reversed(tags)))
        for kind in r.sample(["comments", "aside", "nav", "ad", "social", "form", "notice"], r.randint(0, 3)):
            noise(kind)
        if r.random() < 0.8:
            noise("footer")
        put(r.choice(["</body></html>", ""]))
        return "".join(out), labels

    return [page() for _ in range(n)]


def extract(html: str | None, crf: Crf) -> str:
    found = blocks(html)
    return "\n".join(b.text for b, keep in zip(found, crf.label(found), strict=True) if keep)


def extract_main_text(pages: DataFrame, crf: Crf | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """A row a page: id, the columns of keep, text (content blocks joined by a newline; empty if there are none), n_chars (its code points).

    Whole html; null and pages without text give an empty text. Character references are decoded, white space within a block
    becomes one space. Null and repeated ids pass through, a row each; an empty table gives none; other columns are
    ignored. The model (a few hundred weights) is trained on the driver unless given.
    """
    shared = pages.sparkSession.sparkContext.broadcast(crf or train(labelled_pages()))
    names = [id_col, *keep]

    def per_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h, shared.value) for h in batch.column(len(names)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*names, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(pages.select(*(F.col(c) for c in names), F.col(html_col).cast("string").alias("__html")), per_slice, f"{schema}, text string, n_chars long")
