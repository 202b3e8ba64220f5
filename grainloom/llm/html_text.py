"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into leaf blocks of text in page order. A block is read as its tag path (hashed tags, classes and ids
of the elements around it), its hashed words, and how long, linked and deep it is. A bidirectional LSTM, written and
trained in numpy by backpropagation through time, reads all blocks of a page and labels each as main text or not.
It is trained on pages that are drawn from the layouts described below; nothing of the corpus is looked at.

Defined cases: null and empty html give an empty text; scripts, styles, comments and unseen elements hold no text;
an svg, math, object, canvas or iframe tag that ends in /> holds nothing;
such an element without its end hides nothing, but for a script, style or textarea, which goes on to the end of the page;
elements left open end where their parent ends, an open paragraph where the next block begins; a tag cut off by the
end of the page is dropped; repeated rows give repeated rows; an empty table gives an empty result; extra columns are
ignored. White space is what Unicode calls so.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

PATH, WORDS, MORE = 384, 48, 4
HIDDEN = 12
PAGES, EPOCHS = 500, 9
#: Elements that end a block, that hold no shown text, that have no end tag.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li "
    "main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN_TAGS = "script|style|noscript|template|svg|iframe|textarea|object|canvas|math"
#: Of those, the ones that hold nothing if their tag ends in />.
EMPTY_TAGS = "svg|iframe|object|canvas|math"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Those that last to the end of the page if they have no end.
RAW_TAGS = frozenset("script style textarea".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?!(?:{EMPTY_TAGS})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>)(?P<hide>{HIDDEN_TAGS})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*>|<[a-zA-Z/!][^<>]*\Z|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in HIDDEN_TAGS.split("|")}
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: float):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    buffer: list[str] = []
    at: tuple[str, ...] = ()
    shown = linked = 0

    def flush():
        nonlocal buffer, shown, linked
        if shown:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append(Block(at, text, linked / shown))
        buffer, shown, linked = [], 0, 0

    page = page or ""
    open_ended: set[str] = set()  # hidden elements that have no end in the rest of the page
    tokens = TOKEN.finditer(page)
    while (m := next(tokens, None)) is not None:
        text = m["text"]
        if text is not None:
            n = len(text.strip())
            if n and not shown:
                at = tuple(x for _, x in stack)
            shown += n
            if n and any(t == "a" for t, _ in stack[-4:]):
                linked += n
            buffer.append(text)
            continue
        hidden = m["hide"]
        if hidden is not None:
            hidden = hidden.lower()
            end = None if hidden in open_ended else ENDS[hidden].search(page, m.end())
            if end is not None:
                tokens = TOKEN.finditer(page, end.end())
            elif hidden in RAW_TAGS:
                break
            else:
                open_ended.add(hidden)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag not in VOID and not m["rest"].endswith("/"):
            names = " ".join(x for own in NAMES.findall(m["rest"]) for x in own) if m["rest"] else ""
            stack.append((tag, f"{tag} {names.lower()}" if names else tag))
    flush()
    return out


def bucket(token: str, n: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % n


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Tags around a block, the innermost again by itself, and the parts of classes and ids."""
    v = np.zeros(PATH, np.float32)
    for name in path:
        tag, _, names = name.partition(" ")
        v[bucket(f"<{tag}>", PATH)] = 1
        for part in PARTS.findall(names):
            v[bucket(f".{part.rstrip('s')}", PATH)] = 1
    if path:
        v[bucket(f"<{path[-1].partition(' ')[0]}>!", PATH)] = 1
    return v


class Features:
    """Vectors of blocks; those of the paths and words met last are kept."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def of(self, page: list[Block]) -> np.ndarray:
        x = np.zeros((len(page), PATH + WORDS + MORE), np.float32)
        if len(self.words) > 300_000:
            self.words.clear()
        if len(self.paths) > 20_000:
            self.paths.clear()
        for i, b in enumerate(page):
            if b.path not in self.paths:
                self.paths[b.path] = path_vector(b.path)
            x[i, :PATH] = self.paths[b.path]
            words = b.text.lower().split()
            known = self.words
            for w in words:
                if w not in known:
                    known[w] = bucket(w, WORDS)
            count = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=WORDS)
            x[i, PATH : PATH + WORDS] = np.sqrt(count / len(words))
            x[i, -MORE:] = np.log1p(len(words)) / 4, b.linked, len(b.path) / 8, 1
        return x


def sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * a))


class BiLstm:
    """Columns are pages; gates are in, forget, out and the candidate."""

    def __init__(self, size: int = PATH + WORDS + MORE, hidden: int = HIDDEN, seed: int = 3):
        g = np.random.default_rng(seed)
        self.k = hidden
        self.p = {}
        for d in "fb":
            self.p["W" + d] = (g.standard_normal((4 * hidden, size)) * 0.1).astype(np.float32)
            self.p["U" + d] = (g.standard_normal((4 * hidden, hidden)) * 0.2).astype(np.float32)
            c = np.zeros((4 * hidden, 1), np.float32)
            c[hidden : 2 * hidden] = 1
            self.p["c" + d] = c
        self.p["V"] = (g.standard_normal((1, 2 * hidden)) * 0.2).astype(np.float32)
        self.p["v"] = np.zeros((1, 1), np.float32)

    def run(self, x: np.ndarray, real: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: (steps, pages, size); states (steps, hidden, pages). A step that isn't real leaves the state as it is."""
        k, (steps, n, _) = self.k, x.shape
        a_all = x.reshape(steps * n, -1) @ self.p["W" + d].T
        a_all = a_all.reshape(steps, n, 4 * k).transpose(0, 2, 1) + self.p["c" + d]
        h, s = np.zeros((k, n), np.float32), np.zeros((k, n), np.float32)
        out = np.empty((steps, k, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = a_all[t] + self.p["U" + d] @ h
            gates = sigmoid(a[: 3 * k])
            i, f, o = gates[:k], gates[k : 2 * k], gates[2 * k :]
            g = np.tanh(a[3 * k :])
            m = real[t]
            new_s = m * (f * s + i * g) + (1 - m) * s
            th = np.tanh(new_s)
            new_h = m * (o * th) + (1 - m) * h
            if keep is not None:
                keep.append((t, h, s, i, f, o, g, th, m))
            h, s = new_h, new_s
            out[t] = h
        return out

    def predict(self, x: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        kf, kb = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self.run(x, real, "f", kf), self.run(x, real, "b", kb)], axis=1)
        if keep is not None:
            keep.update(f=kf, b=kb, h=h)
        return sigmoid((self.p["V"] @ h + self.p["v"])[:, 0, :])

    def gradients(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keep: dict = {}
        k = self.k
        p = self.predict(x, real, keep)
        total = real.sum()
        loss = float(-(real * np.where(y > 0.5, np.log(p + 1e-7), np.log(1 - p + 1e-7))).sum() / total)
        ds = (real * (p - y) / total).astype(np.float32)[:, None, :]
        g = {"V": np.einsum("tcn,thn->ch", ds, keep["h"]), "v": np.full((1, 1), ds.sum(), np.float32)}
        dh_all = self.p["V"].T @ ds
        for j, d in enumerate("fb"):
            dw, du, dc = np.zeros_like(self.p["W" + d]), np.zeros_like(self.p["U" + d]), np.zeros_like(self.p["c" + d])
            bh = np.zeros((k, x.shape[1]), np.float32)
            bs = np.zeros_like(bh)
            for t, h, s, i, f, o, c, th, m in reversed(keep[d]):
                dh = dh_all[t, j * k : (j + 1) * k] + bh
                dnew = bs + dh * m * o * (1 - th * th)
                real_ds = dnew * m
                da = np.concatenate([real_ds * c * i * (1 - i), real_ds * s * f * (1 - f), dh * m * th * o * (1 - o), real_ds * i * (1 - c * c)])
                dw += da @ x[t]
                du += da @ h.T
                dc += da.sum(axis=1, keepdims=True)
                bh = dh * (1 - m) + self.p["U" + d].T @ da
                bs = dnew * (m * f + (1 - m))
            g["W" + d], g["U" + d], g["c" + d] = dw, du, dc
        return loss, g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, batch: int = 16, rate: float = 0.02, seed: int = 9) -> float:
        order = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, loss = 0, 0.0
        for e in range(epochs):
            by_length = sorted(order.permutation(len(pages)), key=lambda i: len(pages[i][1]) // 8)
            starts = list(range(0, len(pages), batch))
            losses = []
            for b in order.permutation(len(starts)):
                own = [pages[i] for i in by_length[starts[b] : starts[b] + batch]]
                x, real = padded([a for a, _ in own])
                y = np.zeros_like(real)
                for c, (_, label) in enumerate(own):
                    y[: len(label), c] = label
                value, g = self.gradients(x, real, y)
                losses.append(value)
                step += 1
                for k, v in g.items():
                    np.clip(v, -1, 1, out=v)
                    m1[k] += 0.1 * (v - m1[k])
                    m2[k] += 0.001 * (v * v - m2[k])
                    self.p[k] -= rate * 0.7**e * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
            loss = float(np.mean(losses))
        return loss


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    real = np.zeros((steps, len(pages)), np.float32)
    for c, own in enumerate(pages):
        x[: len(own), c] = own
        real[: len(own), c] = 1
    return x, real


#: Layouts to learn from: where main text stands, and what isn't main text.
MAIN = ("article", "main", "main|article", 'div class="content"', 'div id="content"', 'div class="post"|div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div id="main"|div class="text"', "div", "", 'div class="page"|article', 'td class="body"')
AROUND = ("", 'div id="wrapper"', 'div class="container"', 'div class="layout"|div class="row"', 'table|tr')
LINKS = ("nav", 'div class="menu"', 'ul class="navigation"', 'div class="breadcrumbs"', 'div class="related"', 'div class="share social"', 'ul class="tags"', 'div class="pagination"', 'nav class="toc"', 'div id="menu"')
NOTES = (
    "header", 'div class="header"', "footer", 'div class="footer"', 'div id="footer"', "aside", 'div class="sidebar"', 'div class="ad"', 'div class="ads banner"', 'div class="promo sponsored"', 'div class="advert"',
    'div class="cookie notice"', 'div class="notice"', 'div class="alert consent"', "form", 'form class="search"', 'div class="newsletter signup"', 'div class="subscribe"', 'div class="login modal popup"', 'div class="widget"', 'div class="disclaimer legal"', 'div class="copyright"',
)
COMMENTS = ('div class="comments"', 'section class="comments"', 'ol class="comment-list"', 'div id="comments"|div class="comment"', 'div class="discussion replies"', "section id=\"disqus\"")


class Pages:
    """Draws pages with a label for each of their blocks."""

    def __init__(self, seed: int):
        self.g = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        n = self.g.randint(low, high)
        return " ".join("".join(self.g.choice("bcdfglmnprstvz") + self.g.choice("aeiou") for _ in range(self.g.randint(1, 4))) for _ in range(n)).capitalize() + self.g.choice((".", "", ".", "!"))

    def within(self, path: str, inner: str) -> str:
        for part in reversed([x for x in path.split("|") if x]):
            inner = f"<{part}>{inner}</{part.split()[0]}>"
        return inner

    def mark(self, main: bool) -> str:
        return "\x01" if main else "\x02"

    def paragraph(self, main: bool, low: int, high: int, tag: str = "p") -> str:
        text = self.mark(main) + self.words(low, high)
        if self.g.random() < 0.2:
            text += f' <a href="#">{self.words(1, 3)}</a> {self.words(1, 8)}'
        if self.g.random() < 0.15:
            text = f"<b>{text}" + self.g.choice(("</b>", "<br>", ""))
        return f"<{tag}>{text}" + ("" if tag in ("p", "li") and self.g.random() < 0.15 else f"</{tag}>")

    def links(self, path: str) -> str:
        inner = "".join(f'<li><a href="/x">{self.mark(False)}{self.words(1, 3)}</a></li>' for _ in range(self.g.randint(2, 8)))
        return self.within(path, inner if path.startswith("ul") else f"<ul>{inner}</ul>")

    def note(self, path: str) -> str:
        kind = self.g.random()
        if kind < 0.4:
            return self.within(path, self.mark(False) + self.words(2, 25))
        inner = "".join(self.paragraph(False, 1, 40, self.g.choice(("p", "div", "p", "span", "h3"))) for _ in range(self.g.randint(1, 3)))
        if "form" in path:
            inner += f"<label>{self.mark(False)}{self.words(1, 3)}</label><input name=q><button>{self.mark(False)}{self.words(1, 2)}</button>"
        return self.within(path, inner)

    def comments(self, path: str) -> str:
        tag = "li" if path.startswith("ol") else "div"
        one = lambda: f"<{tag}><h4>{self.mark(False)}{self.words(1, 2)}</h4>{self.paragraph(False, 3, 60)}</{tag}>"
        return self.within(path, "".join(one() for _ in range(self.g.randint(1, 5))))

    def noise(self) -> str:
        return self.links(self.g.choice(LINKS)) if self.g.random() < 0.4 else self.note(self.g.choice(NOTES))

    def main(self, path: str) -> str:
        out = [self.paragraph(True, 2, 12, self.g.choice(("h1", "h1", "h2")))] if self.g.random() < 0.85 else []
        for _ in range(self.g.choice((1, 2, 3, 5, 8, 14))):
            kind = self.g.random()
            if kind < 0.72:
                out.append(self.paragraph(True, 1, self.g.choice((6, 40, 120))))
            elif kind < 0.8:
                out.append(self.paragraph(True, 1, 6, self.g.choice(("h2", "h3"))))
            elif kind < 0.87:
                out.append("<ul>" + "".join(self.paragraph(True, 1, 20, "li") for _ in range(self.g.randint(1, 5))) + "</ul>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{self.mark(True)}{self.words(1, 3)}</td><td>{self.mark(True)}{self.words(1, 5)}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.95:
                out.append(f"<blockquote>{self.paragraph(True, 3, 30)}</blockquote>")
            else:
                out.append(self.noise())
        if self.g.random() < 0.15:
            out.append(self.comments(self.g.choice(COMMENTS)))
        return self.within(path, "".join(out))

    def page(self) -> str:
        body = [self.noise() for _ in range(self.g.randint(0, 4))]
        body.append(self.main(self.g.choice(MAIN)))
        if self.g.random() < 0.35:
            body.append(self.comments(self.g.choice(COMMENTS)))
        body += [self.noise() for _ in range(self.g.randint(0, 4))]
        head = f"<head><title>{self.mark(False)}{self.words(2, 9)}</title></head>" if self.g.random() < 0.9 else ""
        return f"<html>{head}<body>{self.within(self.g.choice(AROUND), ''.join(body))}</body></html>"


def labelled_page(features: Features, page: str) -> tuple[np.ndarray, np.ndarray]:
    own, y = [], []
    for b in blocks(page):
        y.append(float("\x01" in b.text))
        b.text = b.text.replace("\x01", "").replace("\x02", "")
        own.append(b)
    return features.of(own), np.array(y, np.float32)


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 21) -> BiLstm:
    draw, features, net = Pages(seed), Features(), BiLstm()
    net.train([labelled_page(features, draw.page()) for _ in range(pages)], epochs)
    return net


def main_text(batches, model, chunk: int = 48):
    net, features = model.value, Features()
    for batch in batches:
        pages = [blocks(p) for p in batch.column("html").to_pylist()]
        text = [""] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            # long pages are read a few at a time
            n = max(1, min(chunk, 20_000 // len(pages[order[min(at + chunk, len(order)) - 1]])))
            own = order[at : at + n]
            at += n
            x, real = padded([features.of(pages[i]) for i in own])
            p = net.predict(x, real)
            for c, i in enumerate(own):
                text[i] = "\n\n".join(b.text for b, v in zip(pages[i], p[:, c], strict=False) if v >= 0.5)
        own = [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
        yield pa.RecordBatch.from_arrays(own, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    model = pages.sparkSession.sparkContext.broadcast(trained())
    return pages.select("page_id", "url", "html").mapInArrow(partial(main_text, model=model), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
