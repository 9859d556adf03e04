"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = 400  # labelled pages to which the field is fitted
ROUNDS = 90
# Elements that start a block, that have no end tag, and whose content isn't text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe textarea title head select button".split())
# Leaf elements whose own names say little about what they are part of.
LEAVES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 blockquote pre td th figcaption caption".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
    re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")
NOTICE = re.compile(r"©|\(c\)|copyright|cookie|subscribe|newsletter|sign in|log in|read more|advert|sponsored|share", re.I)


@dataclass
class Block:
    text: str
    tags: frozenset[str]  # names of the elements around it
    leaf: str  # the block element that holds it
    names: frozenset[str]  # words of the classes, ids and roles of the elements around it
    own: frozenset[str]  # the same of a paragraph or the like itself, and of what is inline in it
    linked: int  # characters inside links


@dataclass(frozen=True, slots=True)
class _Open:
    """An open element, with what holds for all text inside it."""

    tag: str
    tags: frozenset[str]
    leaf: str
    outer: frozenset[str]
    own: frozenset[str]


_ROOT = _Open("", frozenset(), "", frozenset(), frozenset())


def _joined(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    return a if b <= a else a | b


def leaf_blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """Text between the borders of block elements, in page order; scripts, styles, comments and forms' controls
    are no text. End tags close up to their element; a paragraph ends where a block starts.

    Only names in ``known`` are kept where it is given, so that a block costs the same at any depth.
    """
    found: list[Block] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # where each element stands in the stack
    blocks: list[int] = []  # where block elements stand
    parts: list[str] = []
    state = {"linked": 0, "silent": 0, "links": 0}

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            top = stack[-1] if stack else _ROOT
            is_leaf = top.leaf in LEAVES
            names = top.outer if is_leaf else _joined(top.outer, top.own)
            found.append(Block(text, top.tags, top.leaf, names, top.own if is_leaf else frozenset(), state["linked"]))
        parts.clear()
        state["linked"] = 0

    def add(text: str) -> None:
        if text and not state["silent"]:
            parts.append(text)
            if state["links"]:
                state["linked"] += len(text)

    def push(tag: str, words: frozenset[str]) -> None:
        top = stack[-1] if stack else _ROOT
        tags = _joined(top.tags, frozenset((tag,)))
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            blocks.append(len(stack))
            stack.append(_Open(tag, tags, tag, _joined(top.outer, top.own), words))
        else:
            stack.append(_Open(tag, tags, top.leaf, top.outer, _joined(top.own, words)))
        state["silent"] += tag in SILENT
        state["links"] += tag == "a"

    def pop(n: int) -> None:
        while len(stack) > n:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCKS:
                blocks.pop()
            state["silent"] -= tag in SILENT
            state["links"] -= tag == "a"

    at = 0
    while True:
        m = TOKEN.search(page, at)
        add(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        close, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if places.get(tag):
                depth = places[tag][-1]
                if tag in BLOCKS or not blocks or blocks[-1] < depth:
                    if tag in BLOCKS:
                        flush()
                    pop(depth)
            continue
        if tag in BLOCKS:
            flush()
            last = stack[blocks[-1]].tag if blocks else ""
            if last == "p" or last == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                pop(blocks[-1])
        if tag == "br":
            add(" ")
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        words = (w for n in NAMES.findall(rest) for w in WORD.findall("".join(n).lower())) if rest else ()
        push(tag, frozenset(w for w in words if known is None or w in known))
    flush()
    return found


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Binary features of each block: ancestors, their names, the leaf, the text's shape, the place in the page."""
    out = []
    for i, block in enumerate(blocks):
        text = block.text
        n = text.count(" ") + 1
        features = ["bias", f"words:{min(n, 64).bit_length()}", f"linked:{round(4 * block.linked / max(1, len(text)))}"]
        features += [f"tag:{tag}" for tag in block.tags]
        features += [f"name:{name}" for name in block.names]
        features += [f"own:{name}" for name in block.own]
        features.append(f"leaf:{block.leaf}")
        if text[-1:] in ".!?…":
            features.append("sentence")
        if NOTICE.search(text):
            features.append("notice")
        if i == 0:
            features.append("first")
        if i == len(blocks) - 1:
            features.append("last")
        out.append(features)
    return out


# What page templates call their parts.
MAIN_NAMES = "article content post entry main story body text".split()
SIDE_NAMES = (
    "ad ads advert advertisement banner promo sponsored sidebar side widget related menu nav navigation breadcrumb "
    "breadcrumbs header footer foot masthead topbar cookie notice consent popup modal newsletter subscribe share "
    "social comments comment reply respond login search form tags pagination pager copyright legal toolbar meta"
).split()


def labelled_page(rng: random.Random) -> str:
    """A page with its main text between the marks \\x01 and \\x02."""
    word = lambda: "".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 9)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: line(a, b).capitalize() + rng.choice(("", ".", ".", ".", "?"))

    def name(pool: list[str], odds: float = 0.8) -> str:
        if rng.random() > odds:
            return ""
        extra = rng.choice(("", "-" + word(), " " + word(), "_box"))
        return f' {rng.choice(("class", "id"))}="{rng.choice(pool)}{extra}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(n))

    def side() -> str:
        kind = rng.randrange(11)
        if kind == 10:
            return f"<p{name(SIDE_NAMES, 1)}>{sentence(2, 20)}</p>"
        if kind == 0:
            return f"<nav{name(SIDE_NAMES, 0.3)}><ul>{links(rng.randint(2, 9))}</ul></nav>"
        if kind == 1:
            return f'<div{name(["ad", "ads", "advert", "banner", "promo", "sponsored", "advertisement"], 1)}>{sentence(2, 30)}</div>'
        if kind == 2:
            return f"<aside{name(SIDE_NAMES, 0.4)}><h3>{line(1, 4)}</h3><ul>{links(rng.randint(2, 6))}</ul><p>{sentence(3, 30)}</p></aside>"
        if kind == 3:
            return f'<div{name(["cookie", "notice", "consent", "popup", "banner"], 1)}><p>{sentence(5, 30)}</p><button>{word()}</button></div>'
        if kind == 4:
            return f"<form{name(SIDE_NAMES, 0.4)}><label>{line(1, 4)}</label><input name=q><p>{sentence(2, 12)}</p></form>"
        if kind == 5:
            entries = "".join(f"<{t}{name(['comment', 'reply'], 0.7)}><p>{sentence(4, 40)}</p></{t}>" for t in [rng.choice(("li", "div"))] * rng.randint(1, 5))
            return f'<{rng.choice(("section", "div"))} {rng.choice(("class", "id"))}="{rng.choice(("comments", "comment-list", "responses comments"))}"><h2>{line(1, 3)}</h2>{entries}</div>'
        if kind == 6:
            return f"<header{name(SIDE_NAMES, 0.4)}><h1>{line(1, 4)}</h1><p>{sentence(2, 12)}</p></header>"
        if kind == 7:
            return f'<div{name(["menu", "nav", "sidebar", "widget", "related", "breadcrumb", "topbar"], 1)}><ul>{links(rng.randint(2, 7))}</ul></div>'
        if kind == 8:
            return f'<div{name(["share", "social", "newsletter", "tags", "subscribe", "login"], 1)}><p>{sentence(2, 15)}</p><a href="/">{word()}</a></div>'
        return f'<div{name(["sidebar", "side", "widget", "related"], 1)}><h4>{line(1, 4)}</h4><p>{sentence(4, 40)}</p></div>'

    def paragraph() -> str:
        kind = rng.random()
        text = " ".join(sentence(1, 25) for _ in range(rng.choice((1, 1, 2, 4, 8))))
        if kind < 0.1:
            return f"<h2>{line(1, 8)}</h2>"
        if kind < 0.16:
            return f"<ul><li>{sentence(2, 12)}<li>{sentence(2, 12)}</ul>"
        if kind < 0.2:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.24:
            return f"<div>{text}</div>"
        if kind < 0.27:
            return f"<p>{line(1, 5)} <a href='/x'>{line(1, 6)}</a> {text}</p>"
        if kind < 0.4:
            return f"<p><b>{text}<br>"
        if kind < 0.48:  # paragraphs of the article may be called anything
            return f"<p{name([*SIDE_NAMES, *MAIN_NAMES, word()], 1)}>{text}</p>"
        if kind < 0.54:
            return f"<p><a href='/{word()}'>{text}</a></p>"
        if kind < 0.58:
            return f"<p>{line(1, 5)} <math><mi>{word()}</mi></math> {text}</p>"
        if kind < 0.6:
            return f"<p><object data=x>{line(1, 9)}</object> {text}</p>"
        return f"<p>{text}</p>" if kind < 0.97 else f"<pre>{text}</pre>"

    inner = f"<h1>{line(2, 10)}</h1>" if rng.random() < 0.8 else ""
    body = [inner, *(paragraph() for _ in range(rng.randint(1, 9)))]
    if rng.random() < 0.25:
        body.insert(rng.randint(1, len(body)), "\x02" + side() + "\x01")
    tag = rng.choice(("article", "article", "main", "div", "section"))
    own = name(MAIN_NAMES, 0.4 if tag in ("article", "main") else 1)
    main = f"<{tag}{own}>\x01{''.join(body)}\x02</{tag}>"
    if rng.random() < 0.3:
        main = f"<div{name(['wrapper', 'container', 'page', 'row', 'col'], 1)}>{main}</div>"
    before = "".join(side() for _ in range(rng.randint(0, 3)))
    after = "".join(side() for _ in range(rng.randint(0, 3)))
    foot = f"<footer{name(SIDE_NAMES, 0.3)}>&copy; {word()}.example &middot; {sentence(1, 20)}</footer>" if rng.random() < 0.8 else ""
    return f"<html><head><title>{line(2, 9)}</title></head><body>{before}{main}{after}{foot}</body></html>"


def training_pages(n: int = PAGES, seed: int = 5) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Blocks and labels (1: main text) of generated pages; the marks stand at block borders."""
    rng = random.Random(seed)
    for _ in range(n):
        page = labelled_page(rng)
        blocks = leaf_blocks(re.sub("([\x01\x02])", r"<hr>\1<hr>", page))
        labels, inside, kept = [], False, []
        for block in blocks:
            if block.text in ("\x01", "\x02"):
                inside = block.text == "\x01"
            else:
                kept.append(block)
                labels.append(int(inside))
        yield kept, np.array(labels)


@dataclass(frozen=True)
class Field:
    weights: dict[str, float]  # of label 1 against label 0
    moves: tuple[float, float, float, float]  # scores of 0-0, 0-1, 1-0, 1-1

    @cached_property
    def names(self) -> frozenset[str]:
        """Names of elements that have a weight."""
        return frozenset(f.split(":")[1] for f in self.weights if f.startswith(("name:", "own:")))


def fit(pages: Iterable[tuple[list[Block], np.ndarray]], rounds: int = ROUNDS, decay: float = 0.02) -> Field:
    """Maximum likelihood with a quadratic penalty: forward and backward sums, Adam steps."""
    pages = [p for p in pages if p[0]]
    features = [block_features(blocks) for blocks, _ in pages]
    seen: dict[str, int] = {}
    for page in features:
        for block in page:
            for f in block:
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 4))}
    longest = max(len(p) for p in features)
    x = np.zeros((len(pages), longest, len(index)), np.float32)
    gold, real = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for i, (page, (_, labels)) in enumerate(zip(features, pages, strict=True)):
        gold[i, : len(labels)], real[i, : len(labels)] = labels, True
        for t, block in enumerate(page):
            for f in block:
                if f in index:
                    x[i, t, index[f]] = 1
    flat = x[real]
    w, moves = np.zeros(len(index)), np.zeros((2, 2))
    first, second = [np.zeros(len(index) + 4)] * 2
    pairs = real[:, 1:]
    for step in range(1, rounds + 1):
        score = np.zeros((len(pages), longest, 2))
        score[real, 1] = flat @ w
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            ahead = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + score[:, t]
            forward[:, t] = np.where(real[:, t, None], ahead, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            back = np.logaddexp.reduce(moves + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(real[:, t + 1, None], back, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        one = np.exp(forward + backward - total[:, None, None])[..., 1]
        slope = flat.T @ (gold[real] - one[real]) - decay * len(pages) ** 0.5 * w
        both = np.exp(
            forward[:, :-1, :, None] + moves + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        )[pairs].sum(0)
        truth = np.zeros((2, 2))
        np.add.at(truth, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
        slope = np.concatenate([slope, (truth - both - decay * moves).ravel()])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        change = 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, moves = w + change[:-4], moves + change[-4:].reshape(2, 2)
    return Field({f: float(w[i]) for f, i in index.items()}, tuple(float(v) for v in moves.ravel()))


def viterbi(field: Field, blocks: list[Block]) -> list[bool]:
    """The most probable labels; among equal ones, boilerplate."""
    get = field.weights.get
    m00, m01, m10, m11 = field.moves
    zero = one = 0.0
    back: list[tuple[bool, bool]] = []
    for t, features in enumerate(block_features(blocks)):
        score = sum(get(f, 0.0) for f in features)
        if t:
            from_one = (one + m10 > zero + m00, one + m11 > zero + m01)
            back.append(from_one)
            zero, one = max(zero + m00, one + m10), max(zero + m01, one + m11) + score
        else:
            one = score
    label = one > zero
    labels = [label]
    for from_one in reversed(back):
        label = from_one[label]
        labels.append(label)
    return labels[::-1][: len(blocks)]


def main_text(field: Field, page: str) -> str:
    blocks = leaf_blocks(page, field.names)
    if not blocks:
        return ""
    return "\n".join(b.text for b, kept in zip(blocks, viterbi(field, blocks), strict=True) if kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html", field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty pages have an empty text. Repeated rows stay; other columns are not read. Pages are read whole, and
    the cost of a page follows its length, however deep its elements are nested. Of equally probable labels,
    boilerplate is taken. The field is fitted to ``PAGES`` generated labelled pages unless one is given.
    """
    held = pages.sparkSession.sparkContext.broadcast(field or fit(training_pages()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [main_text(held.value, v.as_py() or "") for v in batch["html"]]
                yield pa.RecordBatch.from_arrays(
                    [batch["page_id"], batch["url"], pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(markup).alias("html"))
    kinds = [rows.schema[name].dataType.simpleString() for name in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
