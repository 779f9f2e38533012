"""Main text of web pages by a recurrent block labeller: a bidirectional LSTM in numpy.

A page is cut into blocks: runs of text between block-level tags, with character references
decoded, text of scripts, styles, the head and hidden elements left out, and white space of a block
turned into one space and trimmed. Each block is described by its tag path (tags, classes and ids of
its open elements, hashed), hashed words of its text, and a few numbers (length, link share,
punctuation, place in the page). A bidirectional LSTM reads the blocks of a page in order and labels
every block main text or not, so that the decision for a block sees the whole page on both sides.

The model is trained here, on a bounded sample of pages (``TRAIN_PAGES`` pages of at most
``TRAIN_BYTES`` of html, smallest hash of page_id first, and of those the first up to
``TRAIN_BLOCKS`` blocks in all). Its targets come from the structure of
the sample pages (``teacher``): text inside an article or main element and outside navigation,
headers, footers, asides, forms and elements whose class or id names adverts, notices, comments,
menus or sidebars. The LSTM learns to label from paths, words and neighbours, and labels every page
of the table in tasks; its weights (a few thousand numbers) are broadcast.

Defined cases: a null or empty page, or one without main blocks, has the empty text; repeated
pages are labelled alike; tags are closed as browsers do for paragraphs and list items, stray end
tags are ignored; text is joined from main blocks in page order by one newline; extra columns of
the input are not carried (page_id and url are).
"""

from __future__ import annotations

import html as html_lib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

TRAIN_PAGES = 2000
TRAIN_BYTES = 1 << 18
#: Blocks of the training sample that reach the driver, at most (about 800 bytes each).
TRAIN_BLOCKS = 100_000
PATH_BUCKETS = 128
WORD_BUCKETS = 64
NUMBERS = 8
FEATURES = PATH_BUCKETS + WORD_BUCKETS + NUMBERS
HIDDEN = 16
#: Pages parsed and labelled together in a task.
PAGES_AT_ONCE = 256

# The block-level and void elements of HTML, and the elements whose text is never shown.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody "
    "td textarea tfoot th thead title tr ul button label".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("script style noscript template head title svg math iframe object canvas".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul li dd dt".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# The teacher's words: containers of the article, and what is not part of it.
MAIN_TAGS = frozenset({"article", "main"})
MAIN_WORDS = frozenset({"article", "content", "post", "entry", "story", "main"})
BOILER_TAGS = frozenset({"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "label", "textarea"})
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement banner cookie cookies consent notice notices comment comments sidebar menu nav "
    "navigation share social related newsletter popup modal promo sponsor sponsored footer breadcrumb breadcrumbs "
    "subscribe widget masthead toolbar disclaimer alert".split()
)


class Block:
    __slots__ = ("path", "text", "link_chars")

    def __init__(self, path: tuple, text: str, link_chars: int):
        self.path, self.text, self.link_chars = path, text, link_chars


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed", "noframes")}


def _attributes(text: str) -> list[tuple[str, str | None]]:
    found = []
    for m in _ATTRIBUTE.finditer(text):
        value = m.group(2)
        if value is not None and value[:1] in "\"'":
            value = value[1:-1]
        found.append((m.group(1).lower(), None if value is None else html_lib.unescape(value)))
    return found


def _words_of(attrs) -> tuple[str, ...]:
    found = []
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            found += [w for w in re.split(r"[\s_\-]+", value.lower()) if w]
    return tuple(found)


def _hidden(attrs) -> bool:
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and (value or "").lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", (value or "").lower()):
            return True
    return False


class _Blocks:
    """Blocks of a page from a stream of tags and text (comments, doctypes and raw text skipped)."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...], bool]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.link_parts = 0
        self.path: tuple = ()
        self.unshown = 0
        self.links = 0

    def _push(self, entry):
        self.stack.append(entry)
        self.unshown += entry[0] in UNSHOWN or entry[2]
        self.links += entry[0] == "a"

    def _pop(self):
        entry = self.stack.pop()
        self.unshown -= entry[0] in UNSHOWN or entry[2]
        self.links -= entry[0] == "a"
        return entry

    def _flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(self.path, text, min(self.link_parts, len(text))))
        self.parts, self.link_parts = [], 0

    def _pop_to(self, tag: str):
        while self.stack:
            if self._pop()[0] == tag:
                break

    def start(self, tag, attrs, closed: bool):
        if tag in BLOCK_TAGS:
            self._flush()
        if closed:
            return
        if tag in CLOSES_P and any(t == "p" for t, _, _ in self.stack):
            self._pop_to("p")
        if tag in ("li", "dt", "dd"):
            for t, _, _ in reversed(self.stack):
                if t in ("ul", "ol", "dl", "menu"):
                    break
                if t in ("li", "dt", "dd"):
                    self._pop_to(t)
                    break
        if tag not in VOID_TAGS:
            self._push((tag, _words_of(attrs), _hidden(attrs)))

    def end(self, tag):
        if tag in BLOCK_TAGS:
            self._flush()
        if any(t == tag for t, _, _ in self.stack):
            self._pop_to(tag)

    def data(self, data):
        if self.unshown:
            return
        if not self.parts or not "".join(self.parts).strip():
            self.path = tuple((t, w) for t, w, _ in self.stack)
        self.parts.append(data)
        if self.links:
            self.link_parts += len(data.strip())

    def feed(self, page: str):
        at = 0
        while at < len(page):
            m = _TOKEN.match(page, at)
            at = m.end()
            if m.group(2) is not None:
                tag = m.group(2).lower()
                if m.group(1):
                    self.end(tag)
                    continue
                attrs = m.group(3) or ""
                self.start(tag, _attributes(attrs), attrs.rstrip().endswith("/") and tag in VOID_TAGS)
                if tag in _RAW_END:
                    # Raw text runs to its end tag; it is text only for a textarea or a title.
                    close = _RAW_END[tag].search(page, at)
                    stop = close.start() if close else len(page)
                    if tag in ("textarea", "title"):
                        self.data(html_lib.unescape(page[at:stop]))
                    at = stop
            elif m.group(0).startswith("<!") or m.group(0).startswith("<?"):
                continue
            else:
                self.data(html_lib.unescape(m.group(0)))


def blocks_of(html: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    if not html:
        return []
    parser = _Blocks()
    parser.feed(html)
    parser._flush()
    return parser.blocks


def teacher(blocks: list[Block]) -> np.ndarray:
    """Targets of the training pages, from their structure: 1 for main text."""
    def within_main(path):
        return any(t in MAIN_TAGS or MAIN_WORDS.intersection(w) for t, w in path)

    has_main = any(within_main(b.path) for b in blocks)
    out = np.zeros(len(blocks))
    for i, b in enumerate(blocks):
        tags = [t for t, _ in b.path]
        inside = within_main(b.path) if has_main else "body" in tags
        boiler = any(t in BOILER_TAGS or BOILER_WORDS.intersection(w) for t, w in b.path)
        header = "header" in tags and not any(t in MAIN_TAGS for t in tags[: tags.index("header")])
        out[i] = float(inside and not boiler and not header)
    return out


def _bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % buckets


class _Buckets:
    """Hashed features of paths and words, remembered per task: both repeat across blocks."""

    def __init__(self):
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            tokens = []
            for tag, words in path:
                if tag in ("html", "body"):
                    continue
                tokens.append("t:" + tag)
                tokens += ["w:" + w for w in words]
            found = self.paths[path] = np.unique(np.array([_bucket(t, PATH_BUCKETS) for t in tokens], np.intp))
        return found

    def word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = self.words[word] = PATH_BUCKETS + _bucket(word, WORD_BUCKETS)
        return found


_SHARED = _Buckets()


def features(blocks: list[Block], buckets: _Buckets | None = None) -> np.ndarray:
    """(blocks, FEATURES): hashed path tokens, hashed words, numbers."""
    buckets = buckets or _SHARED
    if len(buckets.words) > 1_000_000:
        buckets.words.clear()
    x = np.zeros((len(blocks), FEATURES), np.float32)
    n = max(1, len(blocks))
    k = PATH_BUCKETS + WORD_BUCKETS
    for i, b in enumerate(blocks):
        x[i, buckets.path(b.path)] = 1.0
        words = b.text.lower().split()
        np.add.at(x[i], [buckets.word(w) for w in words], 1.0 / len(words))
        text, chars = b.text, len(b.text)
        x[i, k] = math.log1p(chars) / 10
        x[i, k + 1] = math.log1p(len(words)) / 5
        x[i, k + 2] = b.link_chars / chars
        x[i, k + 3] = sum(map(text.count, ".,;:!?")) / chars
        x[i, k + 4] = i / n
        x[i, k + 5] = float(any(t in HEADINGS for t, _ in b.path))
        x[i, k + 6] = sum(map(text.count, "0123456789")) / chars
        x[i, k + 7] = float(text[-1] in ".!?")
    return x


def _sig(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


class BiLSTM:
    """Two LSTMs over the blocks of a page, one each way, and a logistic layer over both states."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def initial(seed: int = 7) -> "BiLSTM":
        rng = np.random.default_rng(seed)
        w = {}
        for d in ("f", "b"):
            w[f"{d}x"] = rng.normal(0, 0.1, (FEATURES, 4 * HIDDEN))
            w[f"{d}h"] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN))
            w[f"{d}c"] = np.zeros(4 * HIDDEN)
            w[f"{d}c"][HIDDEN : 2 * HIDDEN] = 1.0
        w["o"] = rng.normal(0, 0.1, 2 * HIDDEN)
        w["ob"] = np.zeros(1)
        return BiLSTM(w)

    def _run(self, x, m, d):
        t_len, batch, _ = x.shape
        wx, wh, bias = self.w[f"{d}x"], self.w[f"{d}h"], self.w[f"{d}c"]
        h, c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
        states, cache = np.zeros((t_len, batch, HIDDEN)), []
        projected = x @ wx + bias
        for t in range(t_len):
            z = projected[t] + h @ wh
            i, f, o, g = _sig(z[:, :HIDDEN]), _sig(z[:, HIDDEN : 2 * HIDDEN]), _sig(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            mask = m[t][:, None]
            cache.append((h, c, i, f, o, g, tc, mask))
            c = mask * c_new + (1 - mask) * c
            h = mask * (o * tc) + (1 - mask) * h
            states[t] = h
        return states, cache

    def _back(self, x, cache, d_states, d):
        wh = self.w[f"{d}h"]
        grads = {f"{d}x": np.zeros_like(self.w[f"{d}x"]), f"{d}h": np.zeros_like(wh), f"{d}c": np.zeros_like(self.w[f"{d}c"])}
        dz_all = np.zeros((len(cache), x.shape[1], 4 * HIDDEN))
        dh_next = np.zeros((x.shape[1], HIDDEN))
        dc_next = np.zeros_like(dh_next)
        for t in reversed(range(len(cache))):
            h_prev, c_prev, i, f, o, g, tc, mask = cache[t]
            dh = d_states[t] + dh_next
            dh_new, dc_new = mask * dh, mask * dc_next
            do = dh_new * tc
            dc_new = dc_new + dh_new * o * (1 - tc**2)
            dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c_prev * f * (1 - f), do * o * (1 - o), dc_new * i * (1 - g**2)], axis=1)
            dz_all[t] = dz
            grads[f"{d}h"] += h_prev.T @ dz
            dh_next = dz @ wh.T + (1 - mask) * dh
            dc_next = dc_new * f + (1 - mask) * dc_next
        grads[f"{d}x"] = np.einsum("tbf,tbg->fg", x, dz_all)
        grads[f"{d}c"] = dz_all.sum(axis=(0, 1))
        return grads

    def forward(self, x, m):
        """x (time, batch, FEATURES), m (time, batch) of 0/1, sequences padded at the end."""
        forth, cache_f = self._run(x, m, "f")
        back_r, cache_b = self._run(x[::-1], m[::-1], "b")
        both = np.concatenate([forth, back_r[::-1]], axis=2)
        return _sig(both @ self.w["o"] + self.w["ob"][0]), (forth, back_r, both, cache_f, cache_b)

    def gradients(self, x, m, y):
        p, (forth, back_r, both, cache_f, cache_b) = self.forward(x, m)
        total = max(1.0, m.sum())
        dlogit = (p - y) * m / total
        loss = -float(((y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)) * m).sum() / total)
        grads = {"o": np.einsum("tbh,tb->h", both, dlogit), "ob": np.array([dlogit.sum()])}
        d_both = dlogit[:, :, None] * self.w["o"][None, None, :]
        grads.update(self._back(x, cache_f, d_both[:, :, :HIDDEN], "f"))
        grads.update(self._back(x[::-1], cache_b, d_both[::-1, :, HIDDEN:], "b"))
        return loss, grads

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of main text for the blocks of one page."""
        return self.label_many([x])[0]

    def label_many(self, xs: list[np.ndarray], batch: int = 64) -> list[np.ndarray]:
        """Probabilities for many pages, run together in groups of like length."""
        out: list[np.ndarray] = [np.zeros(0)] * len(xs)
        order = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: len(xs[i]))
        for at in range(0, len(order), batch):
            group = order[at : at + batch]
            x, m, _ = _padded([(xs[i], np.zeros(len(xs[i]))) for i in group])
            p, _ = self.forward(x, m)
            for j, i in enumerate(group):
                out[i] = p[: len(xs[i]), j]
        return out


def _padded(pages: list[tuple[np.ndarray, np.ndarray]]):
    t_len = max(len(x) for x, _ in pages)
    x = np.zeros((t_len, len(pages), FEATURES))
    m, y = np.zeros((t_len, len(pages))), np.zeros((t_len, len(pages)))
    for j, (fx, fy) in enumerate(pages):
        x[: len(fx), j], m[: len(fx), j], y[: len(fx), j] = fx, 1.0, fy
    return x, m, y


def fit(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 7) -> BiLSTM:
    """Adam on the pages' (features, targets), pages of like length batched together."""
    model = BiLSTM.initial(seed)
    pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
    if not pages:
        return model
    batches = [_padded(pages[i : i + batch]) for i in range(0, len(pages), batch)]
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        for j in rng.permutation(len(batches)):
            _, grads = model.gradients(*batches[j])
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def training_sample(pages: DataFrame, size: int = TRAIN_PAGES, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """The bounded sample the model is fit to: distinct pages of at most ``most_bytes``, smallest
    hash of (page_id, html) first. Only ids and hashes are ranked; the chosen pages are fetched by a
    join with those ``size`` keys, and copies of one page are taken once."""
    small = pages.where(F.col("html").isNotNull() & (F.length("html") <= most_bytes))
    keyed = small.select("page_id", "html", F.xxhash64("page_id", "html").alias("_h"))
    chosen = keyed.select("_h", "page_id").distinct().orderBy("_h", "page_id").limit(size)
    picked = keyed.join(F.broadcast(chosen), ["_h", "page_id"], "left_semi")
    return picked.dropDuplicates(["_h", "page_id", "html"]).select("page_id", "html", F.col("_h").alias("rank"))


def train(pages: DataFrame, size: int = TRAIN_PAGES, most_bytes: int = TRAIN_BYTES, most_blocks: int = TRAIN_BLOCKS) -> BiLSTM:
    """Fit the labeller; features and targets are made in tasks, and only those of the sample's
    first pages up to ``most_blocks`` blocks in all reach the driver."""

    def describe(batches):
        for part in batches:
            xs, ys, ns = [], [], []
            for html in part.column("html").to_pylist():
                found = blocks_of(html)
                xs.append(features(found).tobytes())
                ys.append(teacher(found).astype(np.float32).tobytes())
                ns.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [part.column("rank"), pa.array(ns, pa.int64()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["rank", "n", "x", "y"]
            )

    sample = training_sample(pages, size, most_bytes).select("rank", "html")
    described = sample.mapInArrow(describe, "rank long, n long, x binary, y binary")
    # The sample is at most ``size`` rows, so one ordered window over it is small.
    running = F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = described.withColumn("_blocks", running).where(F.col("_blocks") <= most_blocks).select("x", "y").collect()
    found = [(np.frombuffer(r.x, np.float32).reshape(-1, FEATURES).astype(np.float64), np.frombuffer(r.y, np.float32).astype(np.float64)) for r in rows]
    return fit(found)


def extract(pages: DataFrame, model: BiLSTM) -> DataFrame:
    """page_id, url, text (main blocks joined by newlines), n_chars (code points of text)."""
    weights = pages.sparkSession.sparkContext.broadcast(model.w)

    def label(batches):
        labeller = BiLSTM(weights.value)
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES_AT_ONCE):
                part = whole.slice(at, PAGES_AT_ONCE)
                pages = [blocks_of(html) for html in part.column("html").to_pylist()]
                chances = labeller.label_many([features(found) for found in pages])
                texts = ["\n".join(b.text for b, p in zip(found, chance, strict=True) if p >= 0.5) for found, chance in zip(pages, chances, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(label, "page_id long, url string, text string, n_chars long")


def by_teacher(html: str | None) -> str:
    """The teacher's own text of a page: the targets as text, for measuring the labeller."""
    found = blocks_of(html)
    return "\n".join(b.text for b, k in zip(found, teacher(found), strict=True) if k)
