"""Main-text extraction with a recurrent block labeller.

A page becomes its sequence of leaf blocks; each block has hashed tag-path and word features. A bidirectional LSTM in numpy
reads the whole sequence and labels every block. It is trained on weak labels: pages of a bounded sample, also with other
page furniture (comments, side bars, notices, forms) built around their articles, so that their roles are known.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import hash_share, sampled

#: The bounded training sample of pages, and the most blocks of a page that is trained on.
SAMPLE_PAGES, SAMPLE_BLOCKS = 240, 120
PATH_BINS, WORD_BINS, DENSE = 96, 32, 9
INPUTS, HIDDEN = PATH_BINS + WORD_BINS + DENSE, 16
STEPS, BATCH, RATE = 160, 24, 0.02
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW_TAGS = frozenset("script style noscript template textarea iframe svg object title select button".split())
#: An open element of the first kind is closed by a start tag of the second.
CLOSED_BY = {"p": BLOCK_TAGS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
             "option": frozenset(["option", "optgroup"])}
#: All that can stand in a head; anything else closes it, as does text.
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements, and words in class, id and role, that mark page furniture; and those that mark an article.
FURNITURE_TAGS = frozenset(["nav", "footer", "aside", "form", "menu", "head", "dialog", "fieldset"])
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus feedback "
    "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo "
    "related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
ARTICLE_WORDS = frozenset("article content entry main post story text body".split())
#: Before other words of a class, these say what the page has besides, as in "layout-with-sidebar".
STATE_WORDS = frozenset("has have with without no hide hidden show".split())
#: These never hold an article; html and body hold everything and say nothing.
NEVER_HOLD, NEUTRAL = frozenset("nav footer aside menu head dialog".split()), frozenset(["html", "body"])
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORDS = re.compile(r"[a-z]+")


class Block:
    """Text of a leaf; its path has (tag, words, number of the element); the last three are set from the whole page."""

    __slots__ = ("path", "text", "linked", "near", "furniture", "inside")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked
        self.near, self.furniture, self.inside = path, False, False


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    out: list[str] = []
    for m in _NAMED.finditer(attributes):
        for name in m[1].lower().split():
            words = _WORDS.findall(name)
            at = next((k for k, w in enumerate(words) if w in STATE_WORDS), len(words))
            out += words[:at]
            if at < len(words):
                out.append("_".join(words[at:]))
    return tuple(out)


def blocks_of(page: str | None) -> list[Block]:
    """Text blocks in page order. Block elements end a block, inline ones and line breaks do not; character references are
    decoded, white space is collapsed, unclosed elements are closed as browsers do."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    parts: list[str] = []
    linked, skip_upto, opened, page = 0, 0, 0, page or ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(stack), text, linked))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() < skip_upto:
            continue
        tag = m[2]
        if tag is None:
            got = m[0]
            if got[0] != "<" or got == "<":
                got = entities.unescape(got) if "&" in got else got
                if stack and stack[-1][0] == "head" and got.strip():
                    flush()
                    del stack[-1]
                parts.append(got)
                if any(e[0] == "a" for e in stack):
                    linked += len(got)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("p", "br") and all(e[0] != tag for e in stack):
                flush() if tag == "p" else parts.append(" ")
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if at is not None and (tag in BLOCK_TAGS or not any(e[0] in BLOCK_TAGS for e in stack[at:])):
                if tag in BLOCK_TAGS:
                    flush()
                del stack[at:]
            continue
        if stack and stack[-1][0] == "head" and tag not in HEAD_TAGS:
            flush()
            del stack[-1]
        if tag in RAW_TAGS:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, m.end())
            skip_upto = close.end() if close else (len(page) if tag in ("script", "style") else m.end())
            if close is None and tag not in ("script", "style"):
                continue
            parts.append(" ")
            continue
        if tag in VOID_TAGS:
            flush() if tag == "hr" else parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                closer = CLOSED_BY.get(stack[k][0])
                if closer and tag in closer:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK_TAGS and stack[k][0] != "p":
                    break
        opened += 1
        stack.append((tag, _names(m[3]), opened))
    flush()
    _place(out)
    return out


def _marked(element: tuple) -> bool:
    return element[0] in FURNITURE_TAGS or not FURNITURE_WORDS.isdisjoint(element[1])


def _article_like(element: tuple) -> bool:
    return element[0] in ("article", "main") or (element[0] not in NEUTRAL and not ARTICLE_WORDS.isdisjoint(element[1]))


def _holders(blocks: list[Block]) -> tuple[set[int], set[int]]:
    """Numbers of the elements that hold the article, and of those that are one.

    Article-like elements without furniture words compete by their unlinked text; where there are none, an element with more
    than half of it and a headline or two longer paragraphs holds the article.
    """
    mass: dict[int, int] = {}
    rich: dict[int, int] = {}
    above: dict[int, tuple] = {}
    total = 0
    for b in blocks:
        n = max(0, len(b.text) - b.linked)
        total += n
        worth = 2 if b.path and b.path[-1][0] == "h1" else int(n >= 80)
        for depth, e in enumerate(b.path):
            mass[e[2]] = mass.get(e[2], 0) + n
            rich[e[2]] = rich.get(e[2], 0) + worth
            above.setdefault(e[2], b.path[: depth + 1])
    like = [k for k, way in above.items() if mass[k] and _article_like(way[-1]) and not _marked(way[-1])]
    if not like:
        wide = {k for k, way in above.items() if 2 * mass[k] > total and rich[k] >= 2 and way[-1][0] not in NEVER_HOLD}
        return wide, set()
    most = max(mass[k] for k in like)
    large = [k for k in like if 2 * mass[k] >= most]
    chosen = {k for k in large if not any(_marked(e) for e in above[k] if e[0] not in NEUTRAL)} or {max(large, key=mass.get)}
    chosen |= {k for k in like if any(e[2] in chosen and 2 * mass[k] >= mass[e[2]] for e in above[k])}
    return {e[2] for k in chosen for e in above[k]}, chosen


def _place(blocks: list[Block]) -> None:
    """Which marks of its path speak about a block: those of elements that neither hold the article nor the whole page."""
    holders, articles = _holders(blocks)
    for b in blocks:
        near, within = [], False
        for e in b.path:
            tag, names, number = e
            if tag in NEUTRAL or (number in holders and number not in articles):
                continue
            if number in articles:
                within = True
                near.append((tag, tuple(n for n in names if n not in FURNITURE_WORDS), number))
                continue
            b.inside = b.inside or _article_like(e)
            named = FURNITURE_WORDS.intersection(names)
            if within or b.inside:
                named -= {"header"}
            if tag in FURNITURE_TAGS or named or (tag == "header" and not within and not b.inside):
                b.furniture = True
            # a header inside the article holds its title
            near.append((tag, tuple(n for n in names if n not in FURNITURE_WORDS or n in named), number))
        b.inside, b.near = b.inside or within, tuple(near)


def is_furniture(block: Block) -> bool:
    """Whether the path speaks against article text; a feature and a part of the training label, never the decision."""
    return block.furniture


def weak_label(block: Block) -> bool:
    """Training label: inside an article and no furniture, or a headline or longer unlinked paragraph outside of any."""
    if block.furniture:
        return False
    return block.inside or ((len(block.text) >= 80 or block.path[-1:] and block.path[-1][0] == "h1") and 2 * block.linked < len(block.text))


def _bin(token: str, size: int, known: dict[str, int] = {}) -> int:
    got = known.get(token)
    if got is None:
        if len(known) > 200_000:
            known.clear()
        got = known[token] = zlib.crc32(token.encode("utf-8", "replace"))
    return got % size


def vectors(blocks: list[Block]) -> np.ndarray:
    """Features of each block: hashed tag path (elements and names, without what holds the article), hashed words, a few dense ones."""
    x = np.zeros((len(blocks), INPUTS), np.float32)
    for row, b in enumerate(blocks):
        for tag, names, _ in b.near:
            x[row, _bin("<" + tag, PATH_BINS)] = 1
            for n in names:
                x[row, _bin("." + n, PATH_BINS)] = 1
        words = b.text.split(" ")
        at = np.fromiter((_bin(w, WORD_BINS) for w in words), np.int64, len(words))
        x[row, PATH_BINS: PATH_BINS + WORD_BINS] = np.bincount(at, minlength=WORD_BINS) / len(words)
        n = len(b.text)
        x[row, PATH_BINS + WORD_BINS:] = (
            np.log1p(n) / 8, np.log1p(len(words)) / 6, min(1.0, b.linked / n), (row + 1) / len(blocks),
            sum(map(b.text.count, ".,;:!?")) / len(words), b.text[-1:] in ".!?\"'", float(is_furniture(b)), 1 / (row + 1), float(b.inside))
    return x


class Labeller:
    """Bidirectional LSTM and a logistic output for each block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(INPUTS)
        self.p = {}
        for way in "fb":
            self.p["X" + way] = (rng.standard_normal((INPUTS, 4 * HIDDEN)) * scale).astype(np.float32)
            self.p["H" + way] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / 8).astype(np.float32)
            self.p["c" + way] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        self.p["O"] = (rng.standard_normal((2 * HIDDEN, 1)) * 0.2).astype(np.float32)
        self.p["o"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, real: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Hidden states [B, T, HIDDEN] in one direction; padded steps carry the state on."""
        p = self.p
        gates = x @ p["X" + way] + p["c" + way]
        h = c = np.zeros((len(x), HIDDEN), np.float32)
        out, tape = np.zeros((*real.shape, HIDDEN), np.float32), []
        for t in range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1):
            g = gates[:, t] + h @ p["H" + way]
            s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN].clip(-30, 30)))
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN: 2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(g[:, 3 * HIDDEN:])
            live = real[:, t, None]
            c2 = np.where(live, f * c + i * u, c)
            h2 = np.where(live, o * np.tanh(c2), h)
            tape.append((t, i, f, o, u, c, h, c2, live))
            h, c = h2, c2
            out[:, t] = h
        return out, tape

    def forward(self, x: np.ndarray, real: np.ndarray) -> tuple:
        hf, tf = self._run(x, real, "f")
        hb, tb = self._run(x, real, "b")
        both = np.concatenate([hf, hb], axis=2)
        return 1 / (1 + np.exp(-(both @ self.p["O"] + self.p["o"])[..., 0].clip(-30, 30))), both, tf, tb

    def gradients(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        prob, both, tf, tb = self.forward(x, real)
        e = ((prob - y) * real / max(1, real.sum())).astype(np.float32)[..., None]
        g = {"O": both.reshape(-1, 2 * HIDDEN).T @ e.reshape(-1, 1), "o": e.sum((0, 1))}
        back = e @ self.p["O"].T
        for way, tape, d in (("f", tf, back[..., :HIDDEN]), ("b", tb, back[..., HIDDEN:])):
            dgates = np.zeros((*real.shape, 4 * HIDDEN), np.float32)
            g["H" + way] = np.zeros_like(self.p["H" + way])
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            for t, i, f, o, u, c, h, c2, live in reversed(tape):
                dh = dh + d[:, t]
                th = np.tanh(c2)
                dcell = dc + dh * o * (1 - th * th)
                dg = np.concatenate([dcell * u * i * (1 - i), dcell * c * f * (1 - f), dh * th * o * (1 - o),
                                     dcell * i * (1 - u * u)], axis=1) * live
                dgates[:, t] = dg
                g["H" + way] += h.T @ dg
                dh = np.where(live, dg @ self.p["H" + way].T, dh)
                dc = np.where(live, dcell * f, dc)
            g["X" + way] = x.reshape(-1, INPUTS).T @ dgates.reshape(-1, 4 * HIDDEN)
            g["c" + way] = dgates.sum((0, 1))
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 3) -> Labeller:
        if not pages:
            return self
        rng = np.random.default_rng(seed)
        mean = {n: np.zeros_like(v) for n, v in self.p.items()}
        square = {n: np.zeros_like(v) for n, v in self.p.items()}
        for step in range(1, STEPS + 1):
            chosen = [pages[k] for k in rng.integers(0, len(pages), BATCH)]
            x, real = padded([v for v, _ in chosen])
            y = np.zeros(real.shape, np.float32)
            for row, (_, labels) in enumerate(chosen):
                y[row, : len(labels)] = labels
            for n, g in self.gradients(x, real, y).items():
                mean[n] += 0.1 * (g - mean[n])
                square[n] += 0.01 * (g * g - square[n])
                m, s = mean[n] / (1 - 0.9 ** step), square[n] / (1 - 0.99 ** step)
                self.p[n] -= (RATE * (1 - 0.9 * step / STEPS) * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, real = np.zeros((len(pages), longest, INPUTS), np.float32), np.zeros((len(pages), longest), bool)
    for row, v in enumerate(pages):
        x[row, : len(v)], real[row, : len(v)] = v, True
    return x, real


def _dressed(page: str, other: str, rng: np.random.Generator) -> str:
    """The page's article with other furniture around it, whose texts come from another page."""
    said = [b.text for b in blocks_of(other)] or ["other"]

    def text() -> str:
        return entities.escape(said[int(rng.integers(len(said)))])

    def short() -> str:
        return " ".join(text().split()[: int(rng.integers(1, 5))])

    extras = [f"<ul><li>{short()}</li><li>{short()}</li></ul>", f"<table><tr><td>{short()}</td><td>{short()}</td></tr></table>",
              f"<h2>{short()}</h2>", f"<blockquote>{text()}</blockquote>", f"<p>{short()}</p>", f"<ol><li><p>{short()}</p></li></ol>",
              f"<dl><dt>{short()}</dt><dd>{short()}</dd></dl>", f"<pre>{short()}</pre>",
              *(f'<div class="{w}"><p>{t()}</p></div>' for w, t in zip(rng.choice(sorted(FURNITURE_WORDS), 2), (text, short)))]
    parts = [f"<p>{entities.escape(b.text)}</p>" for b in blocks_of(page) if weak_label(b)] or [f"<p>{text()}</p>"]
    for extra in extras:
        if rng.random() < 0.4:
            parts.insert(int(rng.integers(len(parts) + 1)), extra)
    body = "".join(parts)
    word = str(rng.choice(sorted(FURNITURE_WORDS)))
    box = str(rng.choice(["article", "main", 'div class="content"', 'div class="post-body"', 'div id="main"', "section"]))
    before = [f"<header><h2>{text()}</h2></header>", f'<div class="{word}"><p>{text()}</p></div>',
              f"<nav><ul><li><a>{text()[:30]}</a></li><li><a>{text()[:30]}</a></li></ul></nav>"]
    after = [f'<section class="comments"><p>{text()}</p><p>{text()}</p></section>', f"<aside><p>{text()}</p></aside>",
             f"<form><p>{text()}</p></form>", f"<footer><p>{text()}</p></footer>", f'<div id="{word}">{text()}</div>']
    often = float(rng.choice([0.0, 0.3, 0.6, 0.6]))
    keep = [x for x in before if rng.random() < often], [x for x in after if rng.random() < often]
    title = str(rng.choice(["{}", "{}", "<header>{}</header>", '<header class="entry-header">{}</header>', '<div class="post-header">{}</div>']))
    around = str(rng.choice(["body", "body", "body", f'body class="has-{word}"', 'div class="layout-with-sidebar"', f'div id="{word}-and-content"', "form"]))
    if rng.random() < 0.25:
        return f"<{around}>{''.join(keep[0])}<h1>{text()[:60]}</h1>{body}{''.join(keep[1])}</{around.split(' ')[0]}>"
    return (f"<{around}>{''.join(keep[0])}<{box}>{title.format(f'<h1>{text()[:60]}</h1>')}{body}</{box.split(' ')[0]}>"
            f"{''.join(keep[1])}</{around.split(' ')[0]}>")


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Labeller:
    """Fit on at most about ``sample`` distinct pages, chosen by hash; the same pages give the same labeller."""
    n = pages.count()
    rows = pages.filter(hash_share(F.col("html"), sample, n)).select("html").distinct().collect()
    texts = sorted(r.html for r in sampled(rows, n) if r.html)
    rng = np.random.default_rng(1)
    dressed = [_dressed(t, texts[int(rng.integers(len(texts)))], rng) for t in texts for _ in range(2)]
    got = [b for b in map(blocks_of, texts + dressed) if b]
    got = [b[:SAMPLE_BLOCKS] for b in got]
    return Labeller().fit([(vectors(b), np.array([weak_label(x) for x in b], np.float32)) for b in got])


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    """Main text of each page: the blocks that the labeller takes."""
    blocks = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if blocks[k]), key=lambda k: len(blocks[k]))
    for lo in range(0, len(order), 64):
        some = order[lo: lo + 64]
        prob = model.forward(*padded([vectors(blocks[k]) for k in some]))[0]
        for row, k in enumerate(some):
            out[k] = "\n".join(b.text for b, p in zip(blocks[k], prob[row]) if p >= 0.5)
    return out


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars for every row. NULL, empty and textless pages have an empty text; repeated rows stay."""
    weights, kinds = model.p, dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        labeller.p = weights
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                texts = main_texts(labeller, some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
