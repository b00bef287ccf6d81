"""Main text of web pages: boosted trees over DOM nodes, decoded over the tree.

A page is parsed into its block elements; inline elements belong to the block
around them.  Every block with text gets features: density and links of its
subtree, words of its attributes and of its ancestors', depth, and how it
stands among its siblings.  Boosted trees give the log-odds that a block is, or
holds, main text.  Decoding picks the set of blocks with the greatest sum of
log-odds such that a kept block's ancestors are kept, so no ancestor and
descendant contradict each other.

The trees are trained here, on pages that ``sample_page`` makes up from a seed
(``TRAINING`` pages, a fixed number); nothing of the input is used for that.

Parsing takes linear time whatever the page: what is looked for and not there
is looked for once, and at most DEPTH blocks are open at a time.  A page without
html or body has them implied; a quote that is never closed does not hide the
end of its tag.

Defined results: null and empty pages have the empty text, an empty table an
empty result; scripts, styles, comments, head, and what only controls show never
count as text; character references are decoded; white space in a block becomes
one space; blocks are joined by a newline in page order; pages of any length are
parsed whole; equal rows give equal texts; columns other than page_id, url and
html are not looked at, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import common
from tessera.llm.trees import BoostedTrees

#: Pages that the trees are trained on, and the seed they come from.
TRAINING, SEED = 2000, 11
#: Elements that start a block; the rest is inline.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
SKIPPED = frozenset("script style noscript template iframe object svg select button textarea canvas audio video title datalist".split())
#: An open element of the first kind ends where one of the others starts.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of attributes by what they tell.
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs pagination pager toc skip sitemap",
    "edge": "header masthead footer foot bottom top topbar copyright legal sidebar side aside rail widget banner",
    "ad": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion promoted outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay toast disclaimer",
    "talk": "comment comments reply replies respond discussion disqus thread reactions",
    "extra": "share sharing social related recommended more newsletter subscribe subscription signup login search form rating tags author bio meta",
    "main": "article content main post entry story body text page",
    "hidden": "hidden none",
}
GROUP = {w: k for k, (_, words) in enumerate(WORDS.items()) for w in words.split()}
KINDS = ["nav", "footer", "aside", "header", "form", "article", "main", "section", "p", "li", "blockquote"]
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_UNQUOTED = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|aria-hidden|style|hidden|data-[\w-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARK = "\u2060"
#: Blocks that may be open at once; what would open deeper stands beside the last of them.
DEPTH = 512
#: Blocks that end others, and where the search for those stops.
_ENDS = {new: frozenset(old for old, by in ENDED_BY.items() if new in by) for new in {x for by in ENDED_BY.values() for x in by}}
_LISTS = frozenset("ul ol dl table menu dir".split())


class _Source:
    """A page's text and where its tags end; what is not there is looked for once, so a page takes linear time."""

    def __init__(self, text: str) -> None:
        self.text, self.absent = text, set()

    def find(self, what: str, at: int) -> int:
        """The next place of what, or -1."""
        found = -1 if what in self.absent else self.text.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def closing(self, name: str, at: int) -> int:
        """After the closing tag of the element, or -1."""
        if name not in self.absent:
            if m := re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.text, at):
                return m.end()
            self.absent.add(name)
        return -1

    def after_head(self, at: int) -> int:
        """Where a head that starts here ends; here, if nothing ends it."""
        if "<head" not in self.absent:
            if m := re.compile(r"</head\s*>|<body\b", re.I).search(self.text, at):
                return m.end() if m[0][1] == "/" else m.start()
            self.absent.add("<head")
        return at

    def tag(self, at: int) -> tuple[int, str | None, bool, str]:
        """What the < at the place starts: its end (the place itself if it is text), the element's name (None: none), whether it closes, attributes."""
        text = self.text
        if text.startswith("<!--", at):
            end = self.find("-->", at + 4)
            return (len(text) if end < 0 else end + 3), None, False, ""
        if text.startswith("<![CDATA[", at):
            return at + 9, None, False, ""
        if text.startswith(("<!", "<?"), at):
            end = self.find(">", at)
            return (at if end < 0 else end + 1), None, False, ""
        m = _NAME.match(text, at + 1)
        if not m:
            return at, None, False, ""
        start = end = m.end()
        while True:
            end = _UNQUOTED.match(text, end).end()
            if end >= len(text) or text[end] == ">":
                break
            quote = self.find(text[end], end + 1)
            if quote < 0:  # never closed: the tag ends as if it were no quote
                end = self.find(">", end)
                break
            end = quote + 1
        if end < 0 or end >= len(text):
            return at, None, False, ""
        return end + 1, m[1].lower(), text[at + 1] == "/", text[start:end]


class Page:
    """A page's blocks, in page order: parents, names, groups of attribute words, and runs of text."""

    def __init__(self, source: str) -> None:
        self.parent, self.name, self.groups, self.inputs = [-1], ["html"], [(0,) * len(WORDS)], [0]
        self.links = [0]  # characters of links directly in a block
        self.inner = [0]  # inline elements directly in a block
        self.runs: list[tuple[int, str]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, run, at, link, size = [0], [], 0, 0, len(source)
        self.open = {"html": 1}
        tags = _Source(source)

        def flush() -> None:
            if run:
                text = " ".join("".join(run).split())
                if text:
                    if len(stack) == 1:
                        self._push(stack, "body", "")
                    self.runs.append((stack[-1], text))
                run.clear()

        def add(piece: str) -> None:
            if "&" in piece:
                piece = entities.unescape(piece)
            run.append(piece)
            if link:
                if len(stack) == 1:
                    self._push(stack, "body", "")
                self.links[stack[-1]] += len(piece.strip())

        while at < size:
            start = source.find("<", at)
            start = size if start < 0 else start
            if start > at:
                add(source[at:start])
            if start == size:
                break
            at, name, closing, attributes = tags.tag(start)
            if at == start:  # no tag: the sign is text
                at += 1
                add("<")
                continue
            if name is None:
                continue
            if name in BLOCKS:
                flush()
                link = 0
                if closing:
                    self._close(stack, name)
                elif name not in ("html", "body") or not self.open.get(name):
                    self._end_implied(stack, name)
                    if len(stack) == 1 and name != "body":
                        self._push(stack, "body", "")
                    self._push(stack, name, attributes)
            elif name == "head" and not closing:
                at = tags.after_head(at)
            elif name in SKIPPED:
                if not closing:
                    after = tags.closing(name, at)
                    if after >= 0:
                        at = after
                    elif name in ("script", "style"):
                        at = size
                    self.inputs[stack[-1]] += name in ("select", "button", "textarea")
            elif name in VOID:
                if name in ("br", "hr"):
                    run.append(" ")
                self.inputs[stack[-1]] += name == "input"
            else:
                self.inner[stack[-1]] += not closing
                if name == "a":
                    link = 0 if closing else 1
        flush()

    def _push(self, stack: list[int], name: str, attributes: str) -> None:
        if len(stack) > DEPTH:
            self._cut(stack, len(stack) - 1)
        self.parent.append(stack[-1])
        self.name.append(name)
        self.groups.append(_groups(attributes) if attributes else self.groups[0])
        for counts in (self.inputs, self.links, self.inner):
            counts.append(0)
        stack.append(len(self.name) - 1)
        self.open[name] = self.open.get(name, 0) + 1

    def _cut(self, stack: list[int], k: int) -> None:
        for block in stack[k:]:
            self.open[self.name[block]] -= 1
        del stack[k:]

    def _close(self, stack: list[int], name: str) -> None:
        if self.open.get(name):
            for k in range(len(stack) - 1, 0, -1):
                if self.name[stack[k]] == name:
                    return self._cut(stack, k)

    def _end_implied(self, stack: list[int], name: str) -> None:
        top = self.name[stack[-1]]
        if top == "p" or top in HEADINGS and name in HEADINGS:
            self._cut(stack, len(stack) - 1)
        ended = _ENDS.get(name, ())
        if any(map(self.open.get, ended)):
            for k in range(len(stack) - 1, 0, -1):
                open_name = self.name[stack[k]]
                if open_name in ended:
                    self._cut(stack, k)
                elif open_name in _LISTS:
                    break


def _groups(attributes: str) -> tuple[int, ...]:
    found = [0] * len(WORDS)
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or ""
        if name == "hidden" or name == "aria-hidden" and "true" in value:
            found[-1] = 1
            continue
        for w in _WORD.findall(value):
            k = GROUP.get(w.lower())
            if k is not None and (k != len(WORDS) - 1 or name == "style" or w.lower() == "hidden"):
                found[k] = 1
    return tuple(found)


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """The blocks whose subtrees hold text, and their features."""
    n = len(page.name)
    parent, name = page.parent, page.name
    own, words, runs, marks = [0] * n, [0] * n, [0] * n, [0] * n
    for k, text in page.runs:
        own[k] += len(text)
        words[k] += text.count(" ") + 1
        runs[k] += 1
        marks[k] += sum(map(text.count, ".,;:!?"))
    chars, links, blocks, inner, inputs, prose = own[:], page.links[:], [1] * n, page.inner[:], page.inputs[:], [0] * n
    all_words, all_runs, all_marks, heads = words[:], runs[:], marks[:], [0] * n
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for total in (chars, links, blocks, inner, inputs, prose, all_words, all_runs, all_marks, heads):
            total[p] += total[k]
        prose[p] += name[k] == "p"
        heads[p] += name[k] in HEADINGS
    depth, above, place, kids, same, before = [0] * n, [(0,) * len(WORDS)] * n, [0] * n, [0] * n, [0] * n, [0] * n
    tags_above = [(0, 0, 0)] * n
    alike: dict[tuple[int, str], int] = {}
    running = 0
    for k in range(1, n):
        p = parent[k]
        depth[k] = depth[p] + 1
        above[k] = tuple(map(max, above[p], page.groups[p]))
        a, b, c = tags_above[p]
        tags_above[k] = (a or name[p] in ("nav", "footer", "aside", "header", "form"), b or name[p] in ("article", "main"), c or name[p] in ("li", "ul", "ol", "table"))
        place[k] = kids[p]
        kids[p] += 1
        alike[p, name[k]] = alike.get((p, name[k]), 0) + 1
        before[k] = running
        running += own[k]
    whole = max(1, chars[0])
    keep = [k for k in range(1, n) if chars[k]]
    rows = []
    for k in keep:
        p = parent[k]
        c = chars[k]
        rows.append(
            (
                depth[k], math.log1p(c), math.log1p(own[k]), min(1.0, links[k] / c), math.log1p(blocks[k]), math.log1p(c / (blocks[k] + inner[k])), all_words[k] / all_runs[k],
                all_marks[k] / all_words[k], c / whole, c / max(1, chars[p]), before[k] / whole, place[k] / max(1, kids[p]), kids[p], alike[p, name[k]] / max(1, kids[p]),
                inputs[k], math.log1p(prose[k]), heads[k], name[k] in HEADINGS, name[k] in ("ul", "ol", "menu"), name[k] in ("div", "td"), *[name[k] == x for x in KINDS],
                *page.groups[k], *above[k], *tags_above[k], name[p] == "body",
            )
        )
    return np.array(keep, np.int64), np.array(rows, float) if rows else np.zeros((0, 0))


def decode(page: Page, blocks: np.ndarray, logits: np.ndarray) -> set[int]:
    """The blocks kept: the set, closed towards the root, with the greatest sum of log-odds."""
    best = dict(zip(blocks.tolist(), logits.tolist()))
    for k in reversed(blocks.tolist()):  # children come after parents
        p = page.parent[k]
        if best[k] > 0 and p in best:
            best[p] += best[k]
    kept = {0}
    for k in blocks.tolist():
        if best[k] > 0 and page.parent[k] in kept:
            kept.add(k)
    return kept


# -- training ------------------------------------------------------------------


def sample_page(r: random.Random) -> str:
    """A made-up page; its main text's runs start with a marking character."""
    vocabulary = ["".join(r.choice("aeiouäé") if k % 2 else r.choice("bcdfglmnprst") for k in range(r.randint(2, 9))) for _ in range(300)]
    attribute = lambda words: f' {r.choice(["class", "class", "id"])}="{r.choice(["", "site-", "page-", "block ", "c-"])}{r.choice(words)}"' if r.random() < 0.9 else ""

    def sentence(low: int, high: int) -> str:
        return " ".join(r.choices(vocabulary, k=r.randint(low, high))).capitalize() + r.choice([".", ".", ".", "", "!", "?", " &amp;", "***", "&nbsp;"])

    def prose(low: int = 1, high: int = 6) -> str:
        out = " ".join(sentence(3, 18) for _ in range(r.randint(low, high)))
        if r.random() < 0.15:
            out = out.replace(" ", f' <a href="/x">{r.choice(vocabulary)}</a> ', 1)
        return r.choice(["", "", "<b>", "<em>"]) + out if r.random() < 0.2 else out

    def menu(items: int) -> str:
        inside = "".join(f'<li><a href="/{k}">{" ".join(r.choices(vocabulary, k=r.randint(1, 2)))}</a></li>' for k in range(items))
        return r.choice([f"<nav><ul>{inside}</ul></nav>", f"<div{attribute(['nav', 'menu', 'navbar', 'breadcrumbs'])}><ul>{inside}</ul></div>", f"<ul{attribute(['menu', 'nav'])}>{inside}</ul>"])

    def advert() -> str:
        return f"<div{attribute(['ad', 'ads', 'advert', 'sponsored', 'promo', 'ad banner'])}>{r.choice([sentence(1, 14), f'<p>{sentence(2, 20)}</p>', f'<a href=/x>{sentence(2, 8)}</a>'])}</div>"

    def notice() -> str:
        return f"<{(t := r.choice(['div', 'section', 'aside']))}{attribute(['cookie-notice', 'consent', 'notice', 'alert', 'popup'])}><p>{sentence(4, 24)}</p>{r.choice(['', '<button>OK</button>'])}</{t}>"

    def form() -> str:
        return f"<form{r.choice(['', attribute(['search', 'login', 'newsletter', 'signup'])])}><label>{sentence(1, 3)}</label><input name=q>{r.choice(['', f'<p>{sentence(3, 12)}</p>', f'<div>{sentence(2, 9)}</div>'])}<button>{sentence(1, 2)}</button></form>"

    def comments() -> str:
        tag = r.choice(["section", "div", "ol", "ul"])
        item = "li" if tag in ("ol", "ul") else r.choice(["div", "article", "p"])
        own = attribute(["comment", "comment-body", "reply"]) if r.random() < 0.7 else ""
        inside = "".join(f"<{item}{own}>{r.choice(['', f'<b>{r.choice(vocabulary)}</b> '])}{sentence(2, 30) if item == 'p' else f'<p>{prose(1, 3)}</p>'}</{item}>" for _ in range(r.randint(1, 7)))
        return f'<{tag} {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "reader-comments", "discussion", "replies"])}">{r.choice(["", f"<h2>{sentence(1, 3)}</h2>"])}{inside}</{tag}>'

    def sidebar() -> str:
        tag = r.choice(["aside", "div"])
        inside = r.choice([menu(r.randint(2, 8)), f"<h3>{sentence(1, 3)}</h3><p>{sentence(4, 30)}</p>", advert(), f"<ul>{''.join(f'<li>{sentence(2, 8)}</li>' for _ in range(4))}</ul>"])
        return f"<{tag}{attribute(['sidebar', 'widget', 'side', 'related', 'rail']) if tag == 'div' else ''}>{inside}</{tag}>"

    def header() -> str:
        tag = r.choice(["header", "div"])
        return f"<{tag}{attribute(['header', 'masthead', 'topbar', 'site-header']) if tag == 'div' else ''}>{r.choice([f'<h1>{sentence(1, 3)}</h1>', f'<p>{sentence(1, 8)}</p>', sentence(1, 6), ''])}{r.choice(['', menu(4)])}</{tag}>"

    def footer() -> str:
        tag = r.choice(["footer", "footer", "div"])
        return f"<{tag}{attribute(['footer', 'copyright', 'legal', 'bottom']) if tag == 'div' else ''}>{r.choice(['&copy; ', '', '<p>'])}{sentence(2, 24)}{r.choice(['', menu(4)])}</{tag}>"

    def main() -> str:
        m, parts = _MARK, []
        if r.random() < 0.9:
            parts.append(f"<h1>{m}{sentence(1, 10)}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.78:
                text = prose()
                parts.append(f"<p>{m}{text}" + r.choice(["</p>", "</p>", "</p>", "<br>", ""]))
            elif kind < 0.84:
                parts.append(f"<{(h := r.choice(['h2', 'h3']))}>{m}{sentence(1, 7)}</{h}>")
            elif kind < 0.89:
                parts.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{m}{sentence(2, 14)}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>")
            elif kind < 0.93:
                parts.append(f"<blockquote>{r.choice(['<p>', ''])}{m}{sentence(3, 30)}</blockquote>")
            elif kind < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{m}{sentence(1, 4)}</td><td>{m}{sentence(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                parts.append(f"<div>{m}{sentence(3, 30)}</div>")
            if r.random() < 0.05:
                parts.append(r.choice([advert, form, notice, sidebar])())
        if r.random() < 0.06:
            parts.append(f"<div{attribute(['share', 'social', 'related', 'tags'])}>{''.join(f'<a href=/s>{r.choice(vocabulary)}</a> ' for _ in range(4))}</div>")
        if r.random() < 0.05:
            parts.append(comments())
        inside, shape = "".join(parts), r.random()
        if shape < 0.62:
            return f"<article{r.choice(['', '', attribute(['post', 'article', 'entry'])])}>{inside}</article>"
        if shape < 0.86:
            return f"<{(t := r.choice(['div', 'main', 'section']))}{attribute(['content', 'post', 'entry-content', 'article-body', 'story', 'main'])}>{inside}</{t}>"
        return inside if shape > 0.96 else f"<div>{inside}</div>"

    if r.random() < 0.12:  # text alone, in a body or in none
        texts = [f"{_MARK}{prose(1, 8)}" for _ in range(r.choice([1, 1, 2, 4]))]
        text = r.choice([r.choice(["<br><br>", " "]).join(texts), "".join(f"<p>{x}</p>" for x in texts)])
        text = r.choice(["", "", f"<h1>{_MARK}{sentence(1, 8)}</h1>"]) + text
        return r.choice([text, f"<body>{text}</body>", f"<html><body>{text}{footer()}</body></html>"])
    body = [header() if r.random() < 0.5 else "", menu(r.randint(2, 9)) if r.random() < 0.8 else "", r.choice(["", "", "<!-- ad 1 -->"])]
    body += [f() for f, p in ((notice, 0.2), (form, 0.2), (advert, 0.6), (sidebar, 0.25)) if r.random() < p]
    middle = main() if r.random() < 0.97 else ""
    middle += "".join(f() for f, p in ((comments, 0.35), (sidebar, 0.3), (advert, 0.2), (form, 0.15)) if r.random() < p)
    if r.random() < 0.3:
        middle = f"<{(t := r.choice(['div', 'main', 'section']))}{attribute(['wrapper', 'container', 'page', 'content', 'main'])}>{middle}</{t}>"
    body += [middle, footer() if r.random() < 0.85 else "", notice() if r.random() < 0.1 else ""]
    return f"<!DOCTYPE html><html><head><title>{sentence(1, 5)}</title><style>p{{margin:0}}</style></head><body>{''.join(body)}</body></html>"


def train(pages: int = TRAINING, seed: int = SEED) -> BoostedTrees:
    r = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        page = Page(sample_page(r))
        marked = [False] * len(page.name)
        for k, text in page.runs:
            if _MARK in text:
                while k >= 0 and not marked[k]:
                    marked[k], k = True, page.parent[k]
        page.runs = [(k, t.replace(_MARK, "")) for k, t in page.runs]
        blocks, x = features(page)
        rows.append(x)
        labels += [marked[k] for k in blocks.tolist()]
    return BoostedTrees().fit(np.concatenate([x for x in rows if len(x)]), np.array(labels, float))


_trained: list[BoostedTrees] = []


def trees() -> BoostedTrees:
    """The trees, trained once in a process."""
    if not _trained:
        _trained.append(train())
    return _trained[0]


def main_texts(sources: list[str], model: BoostedTrees) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    found = [features(p) for p in pages]
    ends = np.cumsum([len(b) for b, _ in found]).tolist()
    logits = model.logit(np.concatenate([x for _, x in found if len(x)])) if ends and ends[-1] else np.zeros(0)
    out = []
    for page, (blocks, _), end in zip(pages, found, ends):
        kept = decode(page, blocks, logits[end - len(blocks) : end])
        out.append("\n".join(t for k, t in page.runs if k in kept))
    return out


def extract(pages: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row (page_id, url, html)."""
    model = model or trees()
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        texts = main_texts(common.texts_of(batch, "html"), model)
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return common.map_batches(pages.select("page_id", "url", "html"), run, schema)
