"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is cut at block-level tags into leaf blocks; inline tags stay inside a block. The
features of a block are its ancestors' tags, their class, id and role words, and its text
(length, share of links, punctuation, place). A chain of two labels, text or not, scores
emissions and transitions together and is decoded by Viterbi, so a short paragraph between
others is kept and one between menu entries is not.

The field is trained on labelled pages: a bounded sample whose blocks are labelled by the
semantic tags they stand in, and copies of those pages under other layouts, with
menus, sidebars, forms, notices and comments of the page's own words in known places, so
that it also reads pages without semantic tags.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast.llm import text as tx

SLOTS = 1 << 12
#: Pages the field is trained on, at most; those of the smallest hash.
MOST_PAGES = 250
EPOCHS = 40

# The tags of HTML by their kind.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr picture source svg path".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr path".split())
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
# An opening tag ends an open one of these, unless one of the second set lies between.
ENDS_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head", "title"}, set()),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tags: list[str]
    names: list[str]
    linked: float


def leaf_blocks(html: str) -> list[Block]:
    """Blocks with text, in page order; character references decoded, white space made one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = in_link = 0

    def close() -> None:
        nonlocal linked, in_link
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                names = [n for _, own in stack for n in own]
                out.append(Block(text, [t for t, _ in stack], names, min(1.0, linked / len(text))))
            pieces.clear()
        linked = 0

    def pop(wanted: set[str], walls: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in walls:
                return
            if stack[i][0] in wanted:
                del stack[i:]
                return

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            pieces.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m["end"] else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        close()
        in_link = 0
        if m["end"]:
            pop({tag}, {"td", "th"} if tag == "p" else set())
            continue
        if tag in ENDS_PARAGRAPH:
            pop({"p"}, {"td", "th", "li", "div", "article", "section", "main"} - {tag})
        if tag in ENDS_SAME:
            pop(*ENDS_SAME[tag])
        if tag not in VOID and not m["attrs"].endswith("/"):
            names = _WORD.findall(" ".join(a or b or c for a, b, c in _NAMES.findall(m["attrs"])).lower()) if m["attrs"] else ()
            stack.append((tag, tuple(names)))
    if at < len(html):
        pieces.append(html[at:])
    close()
    return out


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SLOTS


def block_features(blocks: list[Block]) -> list[list[int]]:
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        names = {f"in:{t}" for t in b.tags} | {f"name:{x}" for x in b.names}
        names.add(f"parent:{b.tags[-1] if b.tags else ''}")
        names.add(f"words:{min(words.bit_length(), 9)}")
        names.add(f"linked:{round(4 * b.linked)}")
        names.add(f"stop:{b.text[-1] in '.!?\"”»…'}")
        names.add(f"sign:{'©' in b.text or '|' in b.text}")
        names.add("first" if i == 0 else "last" if i == n - 1 else "middle")
        out.append(sorted(_slot(x) for x in names))
    return out


# --- labelled pages -----------------------------------------------------------------

# Where semantic tags and usual class names put text and everything else.
TEXT_TAGS = {"article", "main"}
OTHER_TAGS = set("nav footer aside form head title button select menu dialog".split())
OTHER_NAMES = set(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie consent footer header menu nav"
    " navbar navigation newsletter notice popup promo related respond share sharing sidebar social sponsor sponsored"
    " subscribe toolbar widget".split()
)
LAYOUTS = (
    (["html", "body", "article"], []),
    (["html", "body", "main", "article"], ["post"]),
    (["html", "body", "main"], ["content"]),
    (["html", "body", "div", "div"], ["page", "content"]),
    (["html", "body", "div", "section"], ["container", "entry"]),
    (["html", "body", "div"], ["article", "body"]),
)
FURNITURE = (
    (["html", "body", "nav", "ul", "li"], [], 1.0),
    (["html", "body", "div", "ul", "li"], ["menu"], 1.0),
    (["html", "body", "header"], [], 0.0),
    (["html", "body", "header", "h1"], ["site", "header"], 0.0),
    (["html", "body", "aside", "p"], ["sidebar"], 0.0),
    (["html", "body", "div", "p"], ["sidebar", "widget"], 0.0),
    (["html", "body", "div"], ["ad"], 0.0),
    (["html", "body", "div", "p"], ["cookie", "notice"], 0.0),
    (["html", "body", "div", "p"], ["banner"], 0.0),
    (["html", "body", "form", "p"], [], 0.0),
    (["html", "body", "form", "button"], ["newsletter"], 0.0),
    (["html", "body", "footer", "p"], [], 0.0),
    (["html", "body", "section", "div", "p"], ["comments", "comment"], 0.0),
    (["html", "body", "div", "ul", "li"], ["comments"], 0.0),
    (["html", "body", "section", "h2"], ["related"], 0.5),
)
INSIDE = (
    (["aside", "p"], [], 0.0),
    (["aside"], ["advert"], 0.0),
    (["div"], ["ad"], 0.0),
    (["div", "p"], ["ads"], 0.0),
    (["div"], ["share"], 1.0),
    (["nav", "a"], ["breadcrumb"], 1.0),
    (["footer", "p"], [], 0.0),
    (["form", "label"], ["subscribe"], 0.0),
    (["section", "div", "p"], ["comments", "comment"], 0.0),
    (["div", "p"], ["notice"], 0.0),
)


def weak_labels(blocks: list[Block]) -> list[int]:
    return [
        int(bool(TEXT_TAGS & set(b.tags)) and not OTHER_TAGS & set(b.tags) and not OTHER_NAMES & set(b.names)) for b in blocks
    ]


def labelled_pages(html: str, seed: int) -> list[tuple[list[Block], list[int]]]:
    """The page itself and its texts under other layouts, each with the labels of its blocks."""
    blocks = leaf_blocks(html)
    labels = weak_labels(blocks)
    text = [b for b, y in zip(blocks, labels) if y]
    rest = [b for b, y in zip(blocks, labels) if not y]
    pages = [(blocks, labels)]
    if not text:
        return pages
    rng = np.random.default_rng(seed)

    def furniture(kinds: tuple, base: list[str], names: list[str]) -> Block:
        tags, own, linked = kinds[rng.integers(len(kinds))]
        source = (rest or text) if rng.random() < 0.5 else text
        return Block(source[rng.integers(len(source))].text, base + tags, names + own, linked)

    for tags, names in (LAYOUTS[i] for i in rng.choice(len(LAYOUTS), 3, replace=False)):
        made = [(furniture(FURNITURE, [], []), 0) for _ in range(rng.integers(1, 6))]
        for b in text:
            own = b.tags[-1] if b.tags else "p"
            made.append((Block(b.text, tags + [own], names, b.linked), 1))
            if rng.random() < 0.2:
                made.append((furniture(INSIDE, tags, names), 0))
        made += [(furniture(FURNITURE, [], []), 0) for _ in range(rng.integers(1, 6))]
        pages.append(([b for b, _ in made], [y for _, y in made]))
    return pages


# --- the field ----------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """Emission weights of the label text, and transitions; the other label's emissions are zero."""

    w: np.ndarray
    moves: np.ndarray

    def decode(self, blocks: list[Block]) -> list[int]:
        if not blocks:
            return []
        scores = [float(self.w[f].sum()) for f in block_features(blocks)]
        (a, b), (c, d) = self.moves.tolist()
        other, text, back = 0.0, scores[0], []
        for s in scores[1:]:
            to_other = (other + a, 0) if other + a >= text + c else (text + c, 1)
            to_text = (other + b, 0) if other + b >= text + d else (text + d, 1)
            back.append((to_other[1], to_text[1]))
            other, text = to_other[0], to_text[0] + s
        label = int(text > other)
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return path[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]]) -> Field:
    """Adaptive gradient ascent on the conditional likelihood, all pages at once, padded to one length."""
    w, moves = np.zeros(SLOTS), np.zeros((2, 2))
    pages = [p for p in pages if p[1]]
    if not pages:
        return Field(w, moves)
    n, most = len(pages), max(len(y) for _, y in pages)
    mask, gold = np.zeros((n, most)), np.zeros((n, most), dtype=np.int64)
    rows, slots = [], []
    for i, (features, labels) in enumerate(pages):
        mask[i, : len(labels)] = 1
        gold[i, : len(labels)] = labels
        for t, f in enumerate(features):
            rows += [i * most + t] * len(f)
            slots += f
    rows, slots = np.array(rows), np.array(slots)
    seen = np.zeros((2, 2))
    both = mask[:, 1:] * mask[:, :-1]
    np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), both.ravel())
    gw, gm = np.full(SLOTS, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(EPOCHS):
        emit = np.zeros((n, most, 2))
        emit[:, :, 1] = np.bincount(rows, weights=w[slots], minlength=n * most).reshape(n, most)
        emit *= mask[:, :, None]
        forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        forward[:, 0] = emit[:, 0]
        for t in range(1, most):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None] > 0, step, forward[:, t - 1])
        for t in range(most - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None] > 0, step, backward[:, t + 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
        miss = ((gold - chance) * mask).ravel()
        dw = np.bincount(slots, weights=miss[rows], minlength=SLOTS) / n - 1e-4 * w
        pair = forward[:, :-1, :, None] + moves + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        dm = (seen - (np.exp(np.minimum(pair, 0)) * both[:, :, None, None]).sum(axis=(0, 1))) / n - 1e-3 * moves
        gw += dw * dw
        gm += dm * dm
        w += 0.5 * dw / np.sqrt(gw)
        moves += 0.2 * dm / np.sqrt(gm)
    return Field(w, moves)


def train(pages: DataFrame, *, key: str = "page_id", html: str = "html", most_pages: int = MOST_PAGES) -> Field:
    """Fit in one task on at most ``most_pages`` pages; only the weights come to the driver."""
    schema = pa.schema([("w", pa.binary())])
    rows = pages.select(F.xxhash64(F.col(f"`{key}`")).alias("h"), F.col(f"`{html}`").alias("html")).filter("html is not null")
    chosen = rows.orderBy("h", "html").limit(most_pages).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for batch in batches:
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made += [(block_features(b), y) for b, y in labelled_pages(page, h & 0xFFFFFFFF)]
        field = fit(made)
        yield tx.table_rows({"w": [np.concatenate([field.w, field.moves.ravel()]).tobytes()]}, schema)

    found = chosen.mapInArrow(run, "w binary").collect()
    numbers = np.frombuffer(found[0]["w"]) if found else np.zeros(SLOTS + 4)
    return Field(numbers[:SLOTS].copy(), numbers[SLOTS:].reshape(2, 2).copy())


def main_text(html: str, field: Field) -> str:
    blocks = leaf_blocks(html)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(blocks)) if y)


def extract(pages: DataFrame, field: Field, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text`` for every row; text is empty where nothing is text, or html is null.

    Unclosed, nested and cut-off markup is read as browsers do as far as blocks go.
    Repeated rows give repeated results, further columns are not read.
    """
    named = pages.select(
        F.col(f"`{key}`").cast("bigint").alias("page"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html")
    )
    model = pages.sparkSession.sparkContext.broadcast(field)  # fixed size
    schema = pa.schema([("page", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.small_batches(batches, "html"):
            texts = [main_text(x or "", model.value) for x in batch.column(2).to_pylist()]
            yield tx.table_rows({"page": batch.column(0), "url": batch.column(1), "text": texts}, schema)

    return named.mapInArrow(run, "page bigint, url string, text string").withColumnRenamed("page", key)
