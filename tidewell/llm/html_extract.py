"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks of text, each with the path of tags above it.
Hashed tag-path and word vectors of all blocks, in page order, go through a
bidirectional LSTM in numpy, which labels every block as main text or not with
the whole document as context.  The network is trained here, on pages built
from a grammar of page parts, with a fixed seed.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import slices, small_batches, words_of

PATH_SIZE, WORD_SIZE, HIDDEN = 128, 16, 16
FEATURES = PATH_SIZE + WORD_SIZE + 4
PAGES_AT_ONCE = 256

# Elements by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var br wbr img".split())
HIDDEN_TAGS = frozenset("head script style noscript template svg math iframe object canvas audio video".split())
RAW = frozenset("script style textarea title".split())
# An opening tag on the left closes the nearest open one on the right, unless a boundary stands between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BOUNDARY = frozenset("table ul ol dl div section article aside nav body html main form select button".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


@functools.lru_cache(maxsize=1 << 16)
def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """What a tag adds to the path: its name, and the words of its class, id and role."""
    out = [tag]
    for m in _ATTRIBUTE.finditer(attributes):
        out += ["." + p for p in _PART.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(out)


def blocks_of(page: str | None) -> list[tuple[tuple[tuple[str, ...], ...], str, int]]:
    """(path, text, characters within links) of each leaf block that shows text, in page order."""
    out: list = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    hidden = links = 0
    pieces: list[str] = []
    linked, path, at = 0, (), 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append((path, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal hidden, links
        for tag, _ in stack[to:]:
            hidden -= tag in HIDDEN_TAGS
            links -= tag == "a"
        del stack[to:]

    def text_until(end: int) -> None:
        nonlocal linked, path
        if end > at and not hidden:
            if not pieces:
                path = tuple(m for t, m in stack if t not in INLINE or len(m) > 1)
            pieces.append(page[at:end])
            if links:
                linked += end - at

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        text_until(m.start())
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br" and pieces:
            pieces.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if tag in CLOSES_P or tag in CLOSES:
            wanted = ("p",) if tag in CLOSES_P else CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in wanted:
                    pop(k)
                    break
                if stack[k][0] in BOUNDARY:
                    break
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        stack.append((tag, _marks(tag, m[3])))
        hidden += tag in HIDDEN_TAGS
        links += tag == "a"
        if tag == "body" and hidden:  # a head that was never closed
            hidden -= sum(t in HIDDEN_TAGS for t, _ in stack[:-1])
            stack[:] = [x for x in stack if x[0] not in HIDDEN_TAGS]
    text_until(n)
    flush()
    return out


@functools.lru_cache(maxsize=1 << 14)
def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Hashed marks of all levels, and again of the three innermost."""
    out = np.zeros(PATH_SIZE, np.float32)
    for depth, marks in enumerate(reversed(path)):
        for mark in marks:
            out[zlib.crc32(mark.encode()) % PATH_SIZE] += 1
            if depth < 3:
                out[zlib.crc32(f"{depth}:{mark}".encode()) % PATH_SIZE] += 1
    return np.minimum(out, 3)


def features(pages: list[list]) -> list[np.ndarray]:
    """A matrix of blocks by features for each page."""
    flat = [b for p in pages for b in p]
    if not flat:
        return [np.zeros((0, FEATURES), np.float32) for _ in pages]
    x = np.zeros((len(flat), FEATURES), np.float32)
    for k, (path, _, _) in enumerate(flat):
        x[k, :PATH_SIZE] = _path_vector(path)
    texts = pa.array([b[1] for b in flat], pa.string())
    words = words_of(texts)
    n = np.diff(words.first)
    row = np.repeat(np.arange(len(flat)), n)
    bucket = (words.hashes % np.uint64(WORD_SIZE)).astype(np.int64)
    bag = np.bincount(row * WORD_SIZE + bucket, minlength=len(flat) * WORD_SIZE).reshape(len(flat), WORD_SIZE)
    x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = bag / np.maximum(n, 1)[:, None]
    size = np.array([len(b[1]) for b in flat], dtype=np.float32)
    link = np.array([b[2] for b in flat], dtype=np.float32)
    stop = np.array([b[1].count(".") + b[1].count(",") for b in flat], dtype=np.float32)
    x[:, -4:] = np.column_stack([np.log1p(size) / 6, np.log1p(n) / 5, link / np.maximum(size, 1), np.minimum(stop / np.maximum(n, 1), 1)])
    return np.split(x, np.cumsum([len(p) for p in pages])[:-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BlockLabeller:
    """A bidirectional LSTM with one output for each block."""

    weights: dict[str, np.ndarray]

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """x: steps, pages, features.  Gates in order: input, forget, output, candidate."""
        w, u, b = (self.weights[f"{side}{k}"] for k in "wub")
        steps, pages, _ = x.shape
        gates = x @ w + b
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ u
            s = _sigmoid(z[:, : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            m = mask[t][:, None]
            new = f * c + i * g
            tan = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tan, m))
            h, c = m * (o * tan) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """For each step and page."""
        tapes = ([], []) if keep is not None else (None, None)
        hidden = np.concatenate([self._pass(x, mask, "f", tapes[0]), self._pass(x, mask, "r", tapes[1])], axis=2)
        if keep is not None:
            keep |= {"tapes": tapes, "hidden": hidden}
        return hidden @ self.weights["out"] + self.weights["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over blocks and its gradient, through time."""
        keep: dict = {}
        z = self.logits(x, mask, keep)
        p = _sigmoid(z)
        total = mask.sum()
        loss = float((mask * np.logaddexp(0, np.where(target > 0, -z, z))).sum() / total)
        dz = (mask * (p - target) / total).astype(np.float32)
        grads = {"out": np.einsum("tp,tph->h", dz, keep["hidden"]), "bias": dz.sum()}
        dh_all = dz[:, :, None] * self.weights["out"]
        for side, tape, part in (("f", keep["tapes"][0], slice(0, HIDDEN)), ("r", keep["tapes"][1], slice(HIDDEN, 2 * HIDDEN))):
            u = self.weights[f"{side}u"]
            dgates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            du = np.zeros_like(u)
            dh, dc = np.zeros(x.shape[1:2] + (HIDDEN,), np.float32), np.zeros(x.shape[1:2] + (HIDDEN,), np.float32)
            for t, h, c, i, f, o, g, tan, m in reversed(tape):
                dh = dh + dh_all[t][:, part]
                live_h, live_c = m * dh, m * dc
                cell = live_c + live_h * o * (1 - tan * tan)
                d = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), live_h * tan * o * (1 - o), cell * i * (1 - g * g)], axis=1)
                dgates[t] = d
                du += h.T @ d
                dh = d @ u.T + (1 - m) * dh
                dc = cell * f + (1 - m) * dc
            grads[f"{side}u"] = du
            grads[f"{side}w"] = np.einsum("tpf,tpg->fg", x, dgates, optimize=True)
            grads[f"{side}b"] = dgates.sum(axis=(0, 1))
        return loss, grads

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page's features whether each block is main text."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        for at in range(0, len(order), PAGES_AT_ONCE):
            group = order[at : at + PAGES_AT_ONCE]
            x, mask = padded([pages[k] for k in group])
            z = self.logits(x, mask)
            for column, k in enumerate(group):
                out[k] = z[: len(pages[k]), column] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """steps by pages by features, and the mask of real blocks."""
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), FEATURES), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


# Class words of page parts, for the pages trained on.
PARTS = {
    "menu": ("nav menu navbar breadcrumb breadcrumbs pagination navigation", "nav ul div"),
    "header": ("header masthead topbar branding logo", "header div"),
    "footer": ("footer copyright legal colophon credits", "footer div"),
    "side": ("sidebar widget related recommended aside tags popular", "aside div section"),
    "notice": ("cookie notice consent gdpr alert popup modal newsletter subscribe banner", "div section p"),
    "advert": ("ad ads advert advertisement sponsor sponsored promo promotion", "div aside section"),
    "form": ("search login signup contact form", "form div"),
    "comments": ("comments comment reply respond discussion feedback", "div section ul"),
}
MAIN_CLASSES = "article post entry content story body main text page".split()


def sample_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page built from the grammar, and whether each of its blocks is main text."""
    labels: list[bool] = []

    def words(low: int, high: int) -> str:
        n = rng.randint(low, high)
        made = ["".join(rng.choice("aeiouthnrsldcm") for _ in range(rng.randint(1, 8))) for _ in range(n)]
        for k in range(rng.randint(4, 14), n, 11):
            made[k] += rng.choice(".,")
        return " ".join(made).capitalize() + rng.choice([".", ".", ""])

    def attribute(names: list[str]) -> str:
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}{rng.choice(["", "", "-box", "-wrap", "-area"])}"'

    def leaf(tag: str, main: bool, low: int, high: int, link: bool = False) -> str:
        labels.append(main)
        text = words(low, high)
        if link:
            text = f'<a href="/x">{text}</a>'
        elif rng.random() < 0.2:
            text = f"<b>{text}" + rng.choice(["</b>", "", "<br>"])
        return f"<{tag}>{text}" + rng.choice([f"</{tag}>"] * 4 + ([""] if tag in ("p", "li") else []))

    def part(kind: str) -> str:
        names, tags = (x.split() for x in PARTS[kind])
        tag = rng.choice(tags)
        open_ = f"<{tag}{attribute(names) if tag in ('div', 'ul', 'section', 'p') or rng.random() < 0.3 else ''}>"
        if kind == "menu":
            inner = "".join(leaf("li", False, 1, 3, True) for _ in range(rng.randint(2, 7)))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = "".join(leaf(rng.choice(["div", "button", "p", "legend"]), False, 1, 4) for _ in range(rng.randint(1, 3)))
        elif kind == "comments":
            inner = (leaf("h3", False, 1, 3) if rng.random() < 0.6 else "") + "".join(leaf(rng.choice(["p", "div", "li"]), False, 4, 40) for _ in range(rng.randint(1, 5)))
        elif kind in ("advert", "footer", "notice") and rng.random() < 0.6:
            labels.append(False)
            inner = words(1, 30)
        else:
            inner = "".join(leaf(rng.choice(["p", "div", "h4", "li", "span"]) if tag != "p" else "span", False, 1, 20, rng.random() < 0.4) for _ in range(rng.randint(1, 4)))
            if tag == "p" or "<span" in inner:  # spans run together: one block for each stretch
                del labels[len(labels) - inner.count("<p") - inner.count("<div") - inner.count("<h4") - inner.count("<li") - inner.count("<span") :]
                labels.append(False)
                inner = words(2, 25)
        return f"{open_}{inner}</{tag}>"

    def main() -> str:
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        open_ = f"<{tag}{attribute(MAIN_CLASSES) if tag in ('div', 'section') or rng.random() < 0.3 else ''}>"
        out = [leaf("h1", True, 2, 14)] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 25)):
            kind = rng.random()
            if kind < 0.84:
                out.append(leaf("p", True, 1, 90))
            elif kind < 0.9:
                out.append("<ul>" + "".join(leaf("li", True, 2, 15) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.95:
                out.append(leaf(rng.choice(["h2", "h3", "blockquote", "pre"]), True, 2, 20))
            else:
                out.append(part(rng.choice(["advert", "notice", "side", "form"])))
        if rng.random() < 0.15:
            out.append(part("comments"))
        return open_ + "".join(out) + f"</{tag}>"

    before = [part(k) for k in rng.sample(["menu", "header", "notice", "advert", "form"], rng.randint(0, 4))]
    middle = [main()]
    after = [part(k) for k in rng.sample(["side", "comments", "advert", "footer", "notice", "menu", "form"], rng.randint(0, 5))]
    body = "".join(before + middle + after)
    return f"<html><head><title>{words(2, 6)}</title></head><body>{body}</body></html>", labels


@functools.lru_cache(maxsize=4)
def trained(pages: int = 300, rounds: int = 8, seed: int = 5) -> BlockLabeller:
    """The labeller after Adam on sampled pages, always the same for the same arguments."""
    rng, dice = random.Random(seed), np.random.default_rng(seed)
    cases = []
    while len(cases) < pages:
        page, labels = sample_page(rng)
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            cases.append((blocks, np.array(labels, np.float32)))
    xs = features([b for b, _ in cases])
    draw = lambda *s: (dice.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    w = {"out": draw(2 * HIDDEN), "bias": np.zeros((), np.float32)}
    for side in "fr":
        w |= {f"{side}w": draw(FEATURES, 4 * HIDDEN), f"{side}u": draw(HIDDEN, 4 * HIDDEN), f"{side}b": np.zeros(4 * HIDDEN, np.float32)}
    net = BlockLabeller(w)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    order = sorted(range(pages), key=lambda k: len(xs[k]))
    groups = [order[k : k + 25] for k in range(0, pages, 25)]
    step = 0
    for _ in range(rounds):
        rng.shuffle(groups)
        for group in groups:
            step += 1
            x, mask = padded([xs[k] for k in group])
            target = np.zeros_like(mask)
            for column, k in enumerate(group):
                target[: len(xs[k]), column] = cases[k][1]
            _, grads = net.gradients(x, mask, target)
            for k in w:
                g = np.clip(grads[k], -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] = (w[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def extract_text(df: DataFrame, html: str = "html", keep_html: bool = True, labeller: BlockLabeller | None = None) -> DataFrame:
    """Adds text and n_chars (columns of these names are replaced): the page's main text.

    Blocks labelled as main text are joined by newlines in page order, with
    character references decoded and white space collapsed; nothing is capped.
    A null or empty page, or one without main text, has an empty text and 0
    characters.  Rows are judged alone and kept, repeated ones too; an empty
    table gives an empty one; broken markup is read as far as it goes.
    """
    net = labeller or trained()
    names = [c for c in df.columns if c.lower() not in ("text", "n_chars") and (keep_html or c.lower() != html.lower())]
    wide = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{html}`").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__html", 4 << 20):
                pages = [blocks_of(h.as_py()) for h in batch.column("__html")]
                labels = net.label(features(pages))
                texts = ["\n".join(b[1] for b, main in zip(p, keep) if main) for p, keep in zip(pages, labels)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), "text string", "n_chars long"])
    return small_batches(wide).mapInArrow(run, schema)
