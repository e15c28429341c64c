"""Main text of web pages: a recurrent labeller reads a page's blocks in both directions."""

from __future__ import annotations

import html
import re
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Pages and blocks of a page that a labeller is fitted on, at most; every block of every page is labelled.
SAMPLE, SAMPLE_BLOCKS = 300, 200
#: Slots of the hashed tag-path and word vectors.
PATHS, WORDS = 4096, 1024

#: The elements of HTML by how they are read.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "canvas"}
#: Raw elements that end in their own tag where it has a slash, and those whose text is code or never shown, to the end of the page if need be.
EMBEDDED, CODE = {"svg", "iframe", "object", "canvas", "template"}, {"script", "style", "textarea", "title"}
#: Elements of running text.
TEXT_TAGS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "td", "dd")
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Names of page parts that are not the article, in tags, roles, classes and ids.
ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "label", "fieldset", "head", *RAW}
ASIDE_NAMES = set(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus "
    "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promotion recommended related "
    "replies reply responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription syndication tags teaser toolbar topbar widget legal imprint impressum kommentar kommentare werbung anzeige publicidad publicite comentarios commentaires rail outbrain taboola".split()
)
#: Words that take back the names beside them in a class or id, and parts that hold articles of their own.
TAKE_BACK = set("free enabled disabled layout wrapper container less off no without ready loaded has with".split())
HOLDERS = set("comment comments kommentar kommentare comentarios commentaires discussion replies reply responses related recommended promoted sidebar teaser".split())
ARTICLE_TAGS, ARTICLE_NAMES = {"article", "main"}, {"article", "content", "entry", "main", "post", "story", "body"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^<>]*\Z", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """A run of text without a block element inside: its path as steps of tag and names, its text, and how much of it is linked."""

    path: tuple[tuple[str, frozenset[str]], ...]
    text: str
    links: float = 0.0


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order. White space is single and trimmed, character references are decoded.

    A raw element without an end tag is its tag alone, unless it is code. Open tags are counted, so the time grows with the
    page and not with its depth. A path has each different step once.
    """
    page = page or ""
    stack: list[tuple[str, frozenset[str]]] = []
    open_: Counter[str] = Counter()  # of each tag on the stack
    places: dict[tuple[str, frozenset[str]], list[int]] = {}  # of each step on the stack
    found: list[Block] = []
    parts: list[str] = []
    linked = at = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if open_["a"]:
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            steps = sorted((x for x in places if x[0] not in INLINE or x[1] & ASIDE_NAMES), key=lambda x: places[x][-1])  # each where it was last opened
            found.append(Block(tuple(steps), text, min(1.0, linked / max(sum(map(len, parts)), 1))))
        parts.clear()
        linked = 0

    def drop(least: int) -> None:
        while len(stack) > least:
            step = stack.pop()
            open_[step[0]] -= 1
            places[step].pop()
            if not places[step]:
                del places[step]

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, slashed = m[2].lower(), (m[3] or "").endswith("/")
        if tag in RAW and not m[1]:
            if not (slashed and tag in EMBEDDED):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page) if tag in CODE else at
            continue
        names = _names(m[3]) if m[3] and not m[1] else frozenset()
        if tag in INLINE and any(open_[t] for t in TEXT_TAGS):
            names = frozenset()  # inside a sentence names part nothing
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag not in INLINE or names & ASIDE_NAMES:
            flush()
        if m[1]:
            if open_[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                if tag in INLINE and stack[k][1] & ASIDE_NAMES:
                    flush()
                drop(k)
        elif not slashed:
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") or re.fullmatch(r"h[1-6]|div|section|article|footer|nav|ul|ol|aside|header|main|form|table|blockquote|pre", tag):
                # an open p ends where a block begins; an open li ends where the next begins
                for closed in ({"p", tag} if tag in ("li", "dt", "dd", "tr", "td", "th") else {"p"}):
                    k = len(stack) - 1 if open_[closed] else -1
                    while k >= 0 and stack[k][0] != closed and stack[k][0] not in ("ul", "ol", "table", "div", "section", "article"):
                        k -= 1
                    if k >= 0 and stack[k][0] == closed:
                        drop(k)
            places.setdefault((tag, names), []).append(len(stack))
            stack.append((tag, names))
            open_[tag] += 1
    flush()
    return found


def _names(attributes: str) -> frozenset[str]:
    """The words in the classes, ids and roles of a tag; beside a word like `free` or `layout` names of parts don't count."""
    found: set[str] = set()
    for x in _NAMES.findall(attributes):
        for one in " ".join(x).split():
            own = {w.lower() for w in _SPLIT.split(one) if w}
            found |= own - ASIDE_NAMES if own & TAKE_BACK else own
    return frozenset(found)


def _asides(path: tuple) -> bool:
    """Whether the names on a path say that it is a part beside the article; used to label the pages that a labeller is fitted on.

    What stands around a main or article element is its wrapping, unless it holds articles of its own, like comments do. A
    header inside an article belongs to it unless it is named otherwise."""
    mains = [i for i, (tag, names) in enumerate(path) if tag in ARTICLE_TAGS and not names & HOLDERS]
    inner = mains[-1] if mains else -1
    for i, (tag, names) in enumerate(path):
        if i < inner and not names & HOLDERS:
            continue
        if names & ASIDE_NAMES and not (tag in ("body", "html") or names & ARTICLE_NAMES and tag in ARTICLE_TAGS):
            return True
        if tag in ASIDE_TAGS and not (tag == "header" and i > inner >= 0):
            return True
    return False


DENSE = 12
_slots: dict[str, int] = {}


def _slot(word: str) -> int:
    if (found := _slots.get(word)) is None:
        found = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(_slots) < 200_000:
            _slots[word] = found
    return found


def features(found: list[Block]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Per block: dense values, slots of its different path steps, slots of all its words."""
    dense = np.zeros((len(found), DENSE), np.float32)
    paths, words, seen = [], [], Counter(b.text for b in found)
    for i, b in enumerate(found):
        w = b.text.lower().split()
        n, last = len(b.text), b.path[-1][0] if b.path else ""
        dense[i] = (
            any(t in ARTICLE_TAGS for t, _ in b.path), min(len(w), 100) / 100, np.log1p(n) / 10, min(n / max(len(w), 1), 15) / 15, b.text[-1] in ".!?…»\"'", sum(map(b.text.count, ".,;:")) / max(n, 1) * 10, b.links,
            last in ("p", "h1", "h2", "h3", "blockquote", "pre"), last in ("li", "td"), i / len(found), seen[b.text] > 1, 1,
        )
        steps = dict.fromkeys(x for t, s in b.path for x in (t, *sorted(s)))  # each once: nesting alone says nothing
        paths.append(np.array([_slot(x) % PATHS for x in steps] or [0]))
        words.append(np.array([_slot(x) % WORDS for x in w]))
    return dense, paths, words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over block vectors (dense values, mean path vector, mean word vector), with a logistic output."""

    def __init__(self, hidden: int = 16, width: int = 8, dense: int = DENSE, seed: int = 3):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        n = dense + 2 * width
        self.hidden = hidden
        self.p = {"path": init(PATHS, width) * 5, "word": init(WORDS, width) * 5, "out": init(2 * hidden, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": init(n, 4 * hidden), f"h{d}": init(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1

    def inputs(self, feats: tuple) -> tuple[np.ndarray, tuple]:
        dense, paths, words = feats
        made, kept = [dense], []
        for name, lists in (("path", paths), ("word", words)):
            flat, sizes = np.concatenate([np.asarray(x) for x in lists]), np.array([len(x) for x in lists])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            made.append(np.add.reduceat(self.p[name][flat], starts, axis=0) / sizes[:, None].astype(np.float32))
            kept.append((name, flat, sizes))
        return np.concatenate(made, axis=1), kept

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: time x batch x inputs."""
        k, h, c, out, trace = self.hidden, *np.zeros((2, x.shape[1], self.hidden), np.float32), [], []
        gates = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        for t in range(len(x)):
            z = gates[t] + h @ self.p[f"h{d}"]
            s, g = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            i, f, o = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :]
            before, c0 = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out.append(h)
            if keep:
                trace.append((i, f, o, g, tc, before, c0))
        return np.stack(out), trace

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """x: time x batch x inputs; a shorter page in a batch must be of the same length, so pages are grouped by length."""
        both = [self._run(x, "f", False)[0], self._run(x[::-1], "b", False)[0][::-1]]
        return _sigmoid(np.concatenate(both, axis=2) @ self.p["out"] + self.p["bias"])

    def gradients(self, x: np.ndarray, kept: tuple, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over one page (x: blocks x inputs)."""
        k, g = self.hidden, {n: np.zeros_like(v) for n, v in self.p.items()}
        hf, tf = self._run(x[:, None], "f", True)
        hb, tb = self._run(x[::-1, None], "b", True)
        h = np.concatenate([hf, hb[::-1]], axis=2)[:, 0]
        e = (_sigmoid(h @ self.p["out"] + self.p["bias"]) - y) / len(y)
        g["out"], g["bias"][0] = h.T @ e, e.sum()
        dh, dx = e[:, None] * self.p["out"], np.zeros_like(x)
        for d, trace, own, xs in (("f", tf, dh[:, :k], x), ("b", tb, dh[::-1, k:], x[::-1])):
            nh, nc, dz = np.zeros(k, np.float32), np.zeros(k, np.float32), np.zeros((len(x), 4 * k), np.float32)
            for t in range(len(x) - 1, -1, -1):
                i, f, o, gg, tc, before, c0 = (v[0] for v in trace[t])
                hh = own[t] + nh
                c = nc + hh * o * (1 - tc * tc)
                dz[t] = np.concatenate([c * gg * i * (1 - i), c * c0 * f * (1 - f), hh * tc * o * (1 - o), c * i * (1 - gg * gg)])
                g[f"h{d}"] += np.outer(before, dz[t])
                nh, nc = self.p[f"h{d}"] @ dz[t], c * f
            g[f"x{d}"], g[f"c{d}"] = xs.T @ dz, dz.sum(axis=0)
            back = dz @ self.p[f"x{d}"].T
            dx += back if d == "f" else back[::-1]
        at = x.shape[1] - 2 * self.p["path"].shape[1]
        for name, flat, sizes in kept:
            w = self.p[name].shape[1]
            np.add.at(g[name], flat, np.repeat(dx[:, at : at + w] / sizes[:, None], sizes, axis=0))
            at += w
        return g

    def fit(self, pages: list[tuple[tuple, np.ndarray]], epochs: int = 5, least: int = 3000, rate: float = 0.01) -> Labeller:
        """Adam, one page a step, `least` steps at least."""
        epochs = max(epochs, -(-least // max(len(pages), 1))) if pages else 0
        m, v, step = {n: np.zeros_like(x) for n, x in self.p.items()}, {n: np.zeros_like(x) for n, x in self.p.items()}, 0
        rng = np.random.default_rng(5)
        for _ in range(epochs):
            for j in rng.permutation(len(pages)):
                x, kept = self.inputs(pages[j][0])
                step += 1
                for n, d in self.gradients(x, kept, pages[j][1]).items():
                    m[n] += 0.1 * (d - m[n])
                    v[n] += 0.001 * (d * d - v[n])
                    self.p[n] -= (rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


#: Other wrappings that parts beside the article have on the web, used to vary the pages of the sample.
WRAPPINGS = [
    (("div", "cookie notice"),), (("section", "comments"), ("div", "comment")), (("aside", "sidebar"),), (("form", "newsletter"), ("label", "")), (("header", "site header"),), (("div", "social share"),),
    (("div", "menu"), ("ul", ""), ("li", "")), (("div", "sponsored"),), (("div", "site footer"),), (("div", "related"), ("ul", ""), ("li", "")), (("nav", "breadcrumb"),), (("aside", ""),), (("header", ""),), (("form", ""),),
    (("section", "comments"), ("article", "")), (("div", "comment list"), ("article", "comment")), (("section", "kommentare"), ("article", "")), (("div", "legal"),), (("div", "werbung"),), (("section", "comentarios"), ("div", "")),
]


def varied(found: list[Block], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A page with some of its parts beside the article in other wrappings, its article in other wrappings, and whether
    each block is article. Around the article there may be a wrapping whose name is that of a part."""
    outer = tuple((t, n) for t, n in (found[0].path[:2] if found and found[0].path[:1] else ()) if t in ("html", "body"))
    main = [(), (("article", ""),), (("main", ""),), (("div", "content"),), (("div", "post entry"),), (("main", ""), ("article", ""))][rng.integers(6)]
    wrap = lambda steps: tuple((t, frozenset(n.split())) for t, n in steps)
    around = wrap([("div", str(rng.choice(["page header", "site share", "site ad", "page nav"])))]) if main and main[0][0] != "div" and rng.random() < 0.4 else ()
    names = sorted(ASIDE_NAMES)
    out: list[Block] = []
    labels: list[bool] = []
    for b in found:
        if _asides(b.path):
            named = WRAPPINGS[rng.integers(len(WRAPPINGS))] if rng.random() < 0.6 else ((str(rng.choice(["div", "section", "p"])), str(rng.choice(names))),)
            other = Block(outer + wrap(named) + (b.path[-1:] if rng.random() < 0.5 else ()), b.text, b.links)
            out.append(other if rng.random() < 0.6 else b)
            labels.append(False)
        else:
            inner = tuple(x for x in b.path if x[0] not in ("html", "body", "article", "main", "div", "section"))
            out.append(Block(outer + around + wrap(main) + inner, b.text, b.links))
            labels.append(True)
            if rng.random() < 0.1:
                out.append(Block(outer + around + wrap(main) + wrap(WRAPPINGS[rng.integers(len(WRAPPINGS))]) + wrap((("p", ""),)), " ".join(b.text.split()[: rng.integers(3, 40)])))
                labels.append(False)
    return out, labels


def nameless(found: list[Block], rng: np.random.Generator) -> list[Block]:
    """A page whose names say nothing and whose parts are plain div and section: words, links, length and places must tell."""
    plain = {t: ["div", "section"][rng.integers(2)] for t in sorted(ASIDE_TAGS | ARTICLE_TAGS)}
    drawn: dict[frozenset[str], frozenset[str]] = {}
    path = lambda b: tuple((plain.get(t, t), drawn.setdefault(s, frozenset([f"c{rng.integers(100)}"]) if s else s)) for t, s in b.path)
    return [Block(path(b), b.text, b.links) for b in found]


def fit(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """A labeller fitted on at most `sample` different pages, those with the least hashes of their html.

    No page comes with labels. The names and tags on the paths of a sampled page label its blocks; the labeller reads them
    as they are, in other wrappings, and with all names and telling tags taken away, so that it has to go by words, links,
    lengths, places and neighbours where there are no names. Its inputs are computed on whole blocks inside the tasks, as
    they are for every page later; SAMPLE_BLOCKS blocks of a sampled page at most come to the driver.
    """
    hashed = pages.select(F.col("html").cast("string").alias("html")).where("html IS NOT NULL").withColumn("h", F.xxhash64("html"))
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    picked = hashed.where(F.col("h").isin(least)).groupBy("h").agg(F.first("html").alias("html")) if least else hashed

    many = min(12, max(2, 600 // max(len(least), 1)))  # versions of a page: more where there are few pages

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                rng = np.random.default_rng(abs(h))
                own = blocks(page.as_py())[:SAMPLE_BLOCKS]
                labels = [not _asides(b.path) for b in own]
                kinds = [(own, labels), *(varied(own, rng) for _ in range(many)), *((nameless(own, rng), labels) for _ in range(many // 2))]
                if any(labels):  # a page of one paragraph
                    one = int(rng.choice(np.flatnonzero(labels)))
                    kinds.append(([Block(own[one].path[-1:], own[one].text * int(rng.integers(1, 4)))], [True]))
                made.append(pickle.dumps([(features(x), np.array(y, np.float32)) for x, y in kinds if x]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["h", "made"])

    rows = picked.select("h", "html").mapInArrow(examples, "h long, made binary").collect()
    return Labeller().fit([x for r in sorted(rows) for x in pickle.loads(r["made"])])


def extract(pages: DataFrame, model: Labeller, least: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html): the blocks labelled as article, joined by one space.

    Each page is read whole and each block labelled. Null and empty pages have an empty text. Rows come out as often as
    they go in; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                cut = [blocks(p.as_py()) for p in batch.column(2)]
                full = [i for i, b in enumerate(cut) if b]
                texts = [""] * len(cut)
                if full:
                    dense, paths, words = zip(*(features(cut[i]) for i in full))
                    x, _ = model.inputs((np.concatenate(dense), [p for q in paths for p in q], [w for q in words for w in q]))
                    ends = np.cumsum([len(cut[i]) for i in full])
                    by_size: dict[int, list[int]] = {}
                    for j, i in enumerate(full):
                        by_size.setdefault(len(cut[i]), []).append(j)
                    for size, js in by_size.items():
                        said = model.probabilities(np.stack([x[ends[j] - size : ends[j]] for j in js], axis=1))
                        for c, j in enumerate(js):
                            texts[full[j]] = " ".join(b.text for b, p in zip(cut[full[j]], said[:, c]) if p >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
