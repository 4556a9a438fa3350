"""Main text of web pages by a recurrent block labeller.

Method: a page is cut into leaf blocks (runs of text between block-level tags). Each block becomes a vector: a hash of
its tag path (names, classes, ids and roles from the root down), hashed words, and a few measures. A bidirectional LSTM
in numpy reads the sequence of all blocks of the page, so that every block is labelled with the whole document in view;
blocks labelled as main text are joined in page order.

Training: pages have no labels, so the labeller learns from pages that it composes itself: a bounded sample of real blocks
(SAMPLE pages, those of the smallest hash of page_id) is set into layouts of known roles (main text in article, main or a
content box; menus, headers, footers, sidebars, notices, adverts, forms and reader comments around or inside it), and from
the sampled pages themselves where they mark their article. Everything is seeded; every row is extracted from its whole html.

Defined cases: null or empty html, or a page without main text, gives an empty text; an unclosed tag, comment or script
runs to the end, and a comment ends where HTML 5 ends it (`-->`, `--!>`, or at once in `<!-->` and `<!--->`); `</br>` is a break; character
references are decoded as HTML 5 has it, within one run of text; no block is dropped for its length. Repeated rows and equal page_ids give a row
each; a null page_id is kept; columns besides page_id, url and html are ignored, whatever their names. Without pages to learn from, the
labeller is trained on layouts of its own text alone, and an empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.shared import chunks, in_one_task, prepare, string_column, word_hashes, words

#: Sampled pages that the labeller is trained on.
SAMPLE = 100
#: Composed pages and passes of the training.
COMPOSED = 500
EPOCHS = 8
PATH_BINS, WORD_BINS, MEASURES = 96, 32, 8
HIDDEN = 16
#: Pages labelled together.
TOGETHER = 256

BLOCK_TAGS = frozenset(
    "noscript address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td textarea tfoot th thead title tr ul".split()
)
#: Left out with all they hold. An svg tag that closes itself holds nothing; math, object, audio, video, canvas and noscript hold text like any
#: other tag.
RAW_TAGS = "script style template iframe svg".split()
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open tag that one of these closes.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Such a tag doesn't reach beyond these.
BARRIERS = frozenset("ul ol menu dl table select".split())

#: Attributes up to the tag's end: a quote opens a value only right behind an equals sign.
_ATTRS = r"(?:=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|[^\s>]*+)|[^>=])*+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|$))|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<svg(?=[\s/])" + _ATTRS + r"(?<=/)>"
    r"|<(?P<raw>" + "|".join(RAW_TAGS) + r")\b" + _ATTRS + r"(?:>.*?(?:</(?P=raw)\s*>|$)|$)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|$)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>" + _ATTRS + r")(?:>|$)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]*+)))?")
_MARKS = frozenset(("class", "id", "role"))
_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # name, label
    held: list[tuple[str, bool]] = []
    at = 0
    page = page or ""

    def flush() -> None:
        if held:
            # Each run by itself: a reference doesn't go on behind a tag or a comment.
            text = " ".join("".join(html_lib.unescape(x) for x, _ in held).split())
            if text:
                linked = sum(len(x) for x, link in held if link)
                out.append(Block(tuple(label for name, label in stack if name in BLOCK_TAGS or label != name), text, linked))
            held.clear()

    links = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append((page[at : m.start()], links > 0))
        at = m.end()
        name = m["start"]
        if name:
            name = name.lower()
            if name == "br":
                held.append((" ", False))
                continue
            if name in VOID_TAGS and name != "hr":
                continue
            if name in BLOCK_TAGS:
                flush()
                if name == "hr":
                    continue
                names = [n for n, _ in stack]
                if "p" in names and name not in ("button", "option"):
                    k = len(names) - 1 - names[::-1].index("p")
                    if all(n not in BLOCK_TAGS for n in names[k + 1 :]):
                        del stack[k]
                for k in range(len(stack) - 1, -1, -1):
                    if name in CLOSED_BY.get(stack[k][0], ()):
                        del stack[k:]
                        break
                    if stack[k][0] in BARRIERS:
                        break
            attrs = m["attrs"]
            label = name
            if attrs and "=" in attrs:
                marks = [w for a in _ATTR.findall(attrs) if a[0].lower() in _MARKS for w in _NAME.findall((a[1] or a[2] or a[3]).lower())]
                if marks:
                    label = name + "." + ".".join(marks)
            if not attrs.rstrip().endswith("/") or name in BLOCK_TAGS:
                stack.append((name, label))
                links += name == "a"
        elif m["end"]:
            name = m["end"].lower()
            if name == "br":  # as HTML has it, a break
                held.append((" ", False))
                continue
            if name in BLOCK_TAGS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    links -= sum(n == "a" for n, _ in stack[k:])
                    del stack[k:]
                    break
                if name not in BLOCK_TAGS and stack[k][0] in BLOCK_TAGS and name != "a":
                    break
        elif m["raw"] is None and m[0].startswith("<![CDATA["):
            held.append((m[0][9:].removesuffix("]]>"), links > 0))
    if at < len(page):
        held.append((page[at:], links > 0))
    flush()
    return out


_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Signed hashes of the path's labels, their parts, and neighbours; kept for paths seen before."""
    known = _paths.get(path)
    if known is None:
        v = np.zeros(PATH_BINS, np.float32)
        marks = set()
        for depth, label in enumerate(path):
            name, *rest = label.split(".")
            marks |= {f"t:{name}", *(f"c:{x}" for x in rest)}
            if depth:
                marks.add(f"n:{path[depth - 1].split('.')[0]}>{name}")
        if path:
            marks.add(f"leaf:{path[-1].split('.')[0]}")
        for x in sorted(marks):
            h = zlib.crc32(x.encode())
            v[h % PATH_BINS] += 1.0 if h >> 16 & 1 else -1.0
        if len(_paths) > 50_000:
            _paths.clear()
        known = _paths[path] = v
    return known


def vectors(found: list[Block]) -> np.ndarray:
    """(blocks, features) of the blocks of one or more pages, without what depends on the place in the page."""
    x = np.zeros((len(found), PATH_BINS + WORD_BINS + MEASURES), np.float32)
    if not found:
        return x
    x[:, :PATH_BINS] = [_path_vector(b.path) for b in found]
    for lo, hi, data, offsets in chunks(pa.array([b.text for b in found], pa.large_string())):
        starts, ends, row = words(data, offsets)
        h = word_hashes(data, starts, ends)
        sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
        bins = np.bincount(row * WORD_BINS + (h % np.uint64(WORD_BINS)).astype(np.int64), sign, (hi - lo) * WORD_BINS).reshape(-1, WORD_BINS)
        n = np.maximum(np.bincount(row, minlength=hi - lo), 1)
        x[lo:hi, PATH_BINS : PATH_BINS + WORD_BINS] = bins / np.sqrt(n)[:, None] * 0.3
        x[lo:hi, -1] = np.log1p(n) / 4
    for k, b in enumerate(found):
        size = len(b.text)
        x[k, -2] = min(b.linked / size, 1.0)
        x[k, -3] = np.log1p(size) / 6
        x[k, -4] = b.text[-1] in ".!?:\"'"
        x[k, -5] = len(b.path) / 8
    return x


def _placed(x: np.ndarray) -> np.ndarray:
    n = len(x)
    x[:, -6] = np.arange(n) / max(n - 1, 1)
    x[:, -7] = 1.0
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class BlockLabeller:
    """A bidirectional LSTM over blocks with one output each."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        size = PATH_BINS + WORD_BINS + MEASURES
        w = {}
        for side in "fb":
            w[f"{side}x"] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * HIDDEN))
            w[f"{side}h"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            w[f"{side}b"] = np.concatenate((np.ones(HIDDEN), np.zeros(3 * HIDDEN)))  # forget gates start open
        w["o"] = rng.normal(0, 1 / np.sqrt(2 * HIDDEN), 2 * HIDDEN)
        w["ob"] = np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _side(self, side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States (pages, steps, HIDDEN) of one direction; x is in reading order, mask tells real blocks."""
        pages, steps, _ = x.shape
        gates_in = x @ self.weights[f"{side}x"] + self.weights[f"{side}b"]
        wh = self.weights[f"{side}h"]
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((pages, steps, HIDDEN), np.float32)
        tape = []
        for t in range(steps):
            z = gates_in[:, t] + h @ wh
            s = _sigmoid(z[:, : 3 * HIDDEN])
            f, i, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            new = f * c + i * g
            tape.append((h, c, f, i, o, g, np.tanh(new), m))
            c = np.where(m, new, c)
            h = np.where(m, o * np.tanh(new), h)
            out[:, t] = h
        return out, tape

    @staticmethod
    def _flip(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each page's blocks in reverse; what lies behind its end stays there."""
        t = np.arange(x.shape[1])
        at = np.where(t < sizes[:, None], sizes[:, None] - 1 - t, t)
        return np.take_along_axis(x, at[:, :, None], 1)

    def run(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False):
        mask = np.arange(x.shape[1]) < sizes[:, None]
        forth, tape_f = self._side("f", x, mask)
        back, tape_b = self._side("b", self._flip(x, sizes), mask)
        both = np.concatenate((forth, self._flip(back, sizes)), 2)
        p = _sigmoid(both @ self.weights["o"] + self.weights["ob"])
        return (p, both, mask, tape_f, tape_b) if keep else p

    def gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, both, mask, tape_f, tape_b = self.run(x, sizes, True)
        n = mask.sum()
        loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-9) * mask).sum() / n
        d = ((p - y) * mask / n).astype(np.float32)
        grads = {"o": np.einsum("pt,pth->h", d, both), "ob": d.sum(keepdims=True).reshape(1)}
        dh = d[:, :, None] * self.weights["o"]
        for side, tape, slope, inputs in (("f", tape_f, dh[:, :, :HIDDEN], x), ("b", tape_b, self._flip(np.ascontiguousarray(dh[:, :, HIDDEN:]), sizes), self._flip(x, sizes))):
            wh = self.weights[f"{side}h"]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(wh)
            h_next = np.zeros((len(x), HIDDEN), np.float32)
            c_next = np.zeros((len(x), HIDDEN), np.float32)
            for t in range(x.shape[1] - 1, -1, -1):
                h, c, f, i, o, g, tc, m = tape[t]
                total = h_next + slope[:, t]
                live = np.where(m, total, 0)
                dc = np.where(m, c_next, 0) + live * o * (1 - tc * tc)
                dz = np.concatenate((dc * c * f * (1 - f), dc * g * i * (1 - i), live * tc * o * (1 - o), dc * i * (1 - g * g)), 1)
                dz_all[:, t] = dz
                gh += h.T @ dz
                h_next = np.where(m, dz @ wh.T, total)
                c_next = np.where(m, dc * f, c_next)
            grads[f"{side}h"] = gh
            grads[f"{side}x"] = np.einsum("ptx,ptz->xz", inputs, dz_all, optimize=True)
            grads[f"{side}b"] = dz_all.sum((0, 1))
        return float(loss), grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, batch: int = 16, seed: int = 11) -> None:
        """Adam over pages of (vectors, labels)."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                some = [pages[i] for i in order[at : at + batch]]
                x, sizes = padded([v for v, _ in some])
                y = np.zeros(x.shape[:2], np.float32)
                for k, (_, label) in enumerate(some):
                    y[k, : len(label)] = label
                _, grads = self.gradient(x, sizes, y)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] = (self.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def labels(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Which blocks of each page are main text."""
        every = [b for p in pages for b in p]
        x = vectors(every)
        ends = np.cumsum([0] + [len(p) for p in pages])
        own = [_placed(x[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            # Pages of like size go together, up to a bound on padded blocks.
            most = max(1, min(TOGETHER, 20_000 // len(pages[order[min(at + TOGETHER, len(order)) - 1]])))
            some = order[at : at + most]
            p = self.run(*padded([own[i] for i in some]))
            for k, i in enumerate(some):
                out[i] = p[k, : len(pages[i])] >= 0.5
            at += most
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), int(sizes.max(initial=1)), PATH_BINS + WORD_BINS + MEASURES), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
    return x, sizes


# Composed pages: each role with ways in which sites mark it. {} holds the role's blocks.
_MAIN = ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<main><article class="post">{}</article></main>',
         '<div class="article-body">{}</div>', '<section class="story"><div class="entry-content">{}</div></section>', '<div class="post-body">{}</div>', '<div role="main">{}</div>']
_BEFORE = ["<nav>{l}</nav>", '<div class="menu">{l}</div>', '<ul class="nav">{i}</ul>', '<header><div class="logo">{s}</div>{l}</header>', '<div class="ad">{s}</div>', '<div class="cookie-notice"><p>{p}</p></div>',
           '<div class="advert banner"><p>{s}</p></div>', '<div id="header"><p>{s}</p></div>', '<div class="breadcrumb">{l}</div>', '<form action="/s"><label>{s}</label><button>{s}</button></form>',
           '<div class="notice"><p>{p}</p></div>', '<div class="promo sponsored">{s}</div>', '<div role="navigation">{l}</div>', '<aside class="sidebar"><h3>{s}</h3>{l}<p>{p}</p></aside>', '<div class="banner">{p}</div>',
           '<div role="banner">{s}</div>', '<div class="toolbar share">{l}</div>', '<div role="alert">{p}</div>']
_INSIDE = ['<div class="ad">{s}</div>', '<aside><p>{p}</p></aside>', '<div class="related"><h3>{s}</h3>{l}</div>', '<form><label>{s}</label><input name="q"><button>{s}</button></form>', '<div class="newsletter-signup"><p>{p}</p></div>',
           '<div class="share-buttons">{l}</div>', '<div class="advertisement"><p>{p}</p></div>', '<div class="sponsored"><p>{p}</p></div>', '<nav>{l}</nav>']
_AFTER = ["<footer>{s}</footer>", '<footer><p>{p}</p>{l}</footer>', '<div id="footer"><p>{s}</p></div>', '<div class="comments"><h3>{s}</h3><div class="comment"><p>{p}</p></div><div class="comment"><p>{p}</p></div></div>',
          '<section id="comments"><ol class="comment-list"><li><p>{p}</p></li><li><p>{p}</p></li></ol></section>', '<aside><h3>{s}</h3>{l}</aside>', '<div class="sidebar"><p>{p}</p>{l}</div>', '<div class="related-posts">{l}</div>',
          '<div class="subscribe"><form><label>{s}</label><button>{s}</button></form></div>', '<div class="disclaimer legal"><p>{p}</p></div>', '<div class="modal popup"><p>{p}</p></div>', '<div role="complementary"><p>{p}</p></div>',
          '<div class="user-comments"><article class="comment"><p>{p}</p></article></div>', '<div class="copyright">{s}</div>', '<div role="contentinfo">{s}</div>', '<div class="widget">{l}</div>', '<div id="disqus_thread"><p>{p}</p></div>']
_KINDS = ["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<h1>{}</h1>", "<h2>{}</h2>", "<ul><li>{}</li><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<p><b>{}<br>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<div>{}</div>", "<figure><figcaption>{}</figcaption></figure>"]


def composed(texts: list[str], count: int = COMPOSED, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of pages made of the given texts in random layouts."""
    rng = np.random.default_rng(seed)
    texts = texts or ["text"]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def some(lo: int, hi: int) -> str:
        w = pick(texts).split() or ["text"]
        k = int(rng.integers(len(w)))
        return " ".join(w[k : k + int(rng.integers(lo, hi))])

    def filled(layout: str) -> str:
        links = "".join(f'<a href="/{k}">{some(1, 4)}</a>' if rng.random() < 0.5 else f'<li><a href="#">{some(1, 4)}</a></li>' for k in range(int(rng.integers(1, 7))))
        out = layout.replace("{l}", links).replace("{i}", "".join(f"<li><a href='/'>{some(1, 3)}</a></li>" for _ in range(4)))
        while "{p}" in out:
            out = out.replace("{p}", some(4, 60), 1)
        while "{s}" in out:
            out = out.replace("{s}", some(1, 9), 1)
        return out

    pages = []
    for _ in range(count):
        mark = ""
        body = []
        if rng.random() < 0.8:
            body.append(f"<h1>{mark}{some(2, 12)}</h1>")
        for _ in range(int(rng.integers(1, 9))):
            kind = pick(_KINDS)
            while "{}" in kind:
                kind = kind.replace("{}", mark + some(1, 120), 1)
            body.append(kind)
            if rng.random() < 0.12:
                body.append(filled(pick(_INSIDE)))
        before = "".join(filled(pick(_BEFORE)) for _ in range(int(rng.integers(0, 4))))
        after = "".join(filled(pick(_AFTER)) for _ in range(int(rng.integers(0, 4))))
        page = f"<html><head><title>{some(2, 12)}</title><style>p</style></head><body>{before}{pick(_MAIN).replace('{}', ''.join(body))}{after}</body></html>"
        if rng.random() < 0.2:
            page = page.replace("<body>", '<body><div class="wrapper">')
        found = blocks(page)
        label = np.array([b.text.startswith(mark) for b in found], np.float32)
        for b in found:
            b.text = b.text.removeprefix(mark) or "x"
        pages.append((_placed(vectors(found)), label))
    return pages


_ASIDE = re.compile(r"^(nav|aside|footer|header|form|title|head|button|select)\b|\.(ads?|advert\w*|comments?|sidebar|menu|notice|share|related|promo)(\.|$)")


def marked(found: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its article by a tag of that name, else None."""
    if not any(p.split(".")[0] == "article" for b in found for p in b.path):
        return None
    return np.array([any(p.split(".")[0] == "article" for p in b.path) and not any(_ASIDE.search(p) for p in b.path) for b in found], np.float32)


def fit(pages: DataFrame, sample: int = SAMPLE) -> BlockLabeller:
    """A labeller trained on composed pages and on the sampled ones that mark their article."""
    prepare(pages.sparkSession)
    # Only ids take part in the choice; the sampled pages alone come to the driver.
    few = pages.select("page_id").na.drop().distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    # A repeated page_id brings the least of its pages, so the task's rows are bounded by the sample.
    rows = pages.select("page_id", "html").join(F.broadcast(few), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))

    def run(table: pa.Table) -> BlockLabeller:
        table = table.sort_by([("page_id", "ascending"), ("html", "ascending")])
        return trained(table["html"].to_pylist())

    return in_one_task(rows, run) or trained([])


def trained(htmls: list[str | None]) -> BlockLabeller:
    real = [b for b in map(blocks, htmls) if b]
    texts = [b.text for p in real for b in p]
    examples = composed(texts)
    for found in real:
        label = marked(found)
        if label is not None:
            examples.append((_placed(vectors(found)), label))
    model = BlockLabeller.fresh()
    model.train(examples)
    return model


def extract(pages: DataFrame, labeller: BlockLabeller) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    prepare(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(pickle.dumps(labeller))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(held.value)
        for batch in batches:
            found = [blocks(x.as_py()) for x in string_column(batch, "html")]
            texts = ["\n".join(b.text for b, k in zip(p, keep, strict=True) if k) for p, keep in zip(found, model.labels(found), strict=True)]
            yield pa.record_batch(
                {"page_id": string_column(batch, "page_id"), "url": string_column(batch, "url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            )

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
