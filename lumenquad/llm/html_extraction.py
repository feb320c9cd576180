"""Main text of web pages by suffix arrays of their hosts.

Each page is cut into blocks by its markup. What HTML states by element is left out (menus, footers, asides, forms,
scripts, a header outside an article), and what a class, id or role states as a whole: a name made up of words for such
parts and of words for places ("ad", "cookie-notice", "sidebar left"), not one that only mentions them ("has-sidebar").
A form or a part so named that holds the article is no such part itself.

The blocks' tokens of all pages of a host are then concatenated and their suffixes are named by prefix doubling up to
`least` tokens; in the array sorted by name, equal strings of that length are neighbours. A string is boilerplate if it
is on `share` of the pages, `few` at least, and if two of them have a quarter of their text to themselves: copies of an
article hold little but one another's text, so they stay whole. Blocks that boilerplate covers go, and so do covered runs of that
length inside a block; unique runs stay.

Hosts of any size are judged as one, and alike for every `group`: their pages are dealt by page into groups of about that
size. A string on the share of all pages is on that share of some group's; what a group has so is a candidate, which
every group counts on its own pages, and the sums decide. The second test, of pages with text to themselves, is counted
and summed the same way, on what passed the first. A host that is one group is decided where it lies.

Strings are looked at by their first `least` tokens alone. That loses nothing: each part of that length of a longer
repeated string is on as many pages as the whole, so the longest repeated strings and these parts cover the same tokens.

Defined cases: null and empty html give an empty text; a null url is a host of its own kind; unclosed and stray tags
are closed as browsers do or ignored; very long pages are parsed one at a time beyond 4 MB; repeated rows are pages of
their own and, as copies of one another, stay whole; ties in the order of suffixes don't matter, as only equal names
count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import find
from .common import mix, pieces, shuffle_width, staged, trimmed

BROADCAST_HOSTS = 100_000
OWN = 0.25  # share of a page's tokens that nothing often repeated covers

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
MARKS = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of HTML: elements by their part in the page.
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form button select svg canvas object dialog head menu header".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead"
    " tr ul".split()
)
SPACED = frozenset(["br", "td", "th", "img", "option"])
#: Words for parts of a page other than the article, and words that say where or how such a part stands.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo cookie cookies consent gdpr"
    " notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments"
    " disqus respond sharing social related newsletter subscribe subscription popup modal login signup searchbox"
    " searchform pagination pager widget widgets complementary contentinfo".split()
)
PLACES = frozenset(
    "site page global top bottom left right upper lower primary secondary main inner outer box bar block list area"
    " section wrap wrapper container slot unit item links link form reader readers user users body thread".split()
)
COMMENTS = re.compile(r"\b(?:comments?|disqus|respond)\b", re.IGNORECASE)


def declared(name: str, article: bool) -> bool:
    """Whether a class, id or role as a whole names a part other than the article; a header in an article is its own."""
    words = [w.lower() for w in WORDS.findall(name)]
    parts = [w for w in words if w in PARTS and not (article and w in ("header", "banner"))]
    return bool(parts) and all(w in PARTS or w in PLACES for w in words)


class Page:
    """Blocks of a page as lists of (text, left-out elements around it)."""

    def __init__(self, page: str):
        self.blocks: list[list[tuple[str, tuple[int, ...]]]] = [[]]
        self.whole: set[int] = set()  # left-out elements that hold the article: they aren't left out
        self.kinds: dict[int, str] = {}  # left-out element: stated, named or form
        self.stack: list[tuple[str, tuple[int, ...], bool]] = []  # element, left-out ones around it, in an article
        self.parse(page)

    def end_block(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def add(self, text: str) -> None:
        self.blocks[-1].append((text, self.stack[-1][1] if self.stack else ()))

    def pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            if self.stack.pop()[0] in BLOCKS:
                self.end_block()

    def holds_article(self, out: tuple[int, ...]) -> None:
        """An article starts inside these: forms and named parts are wrappers, unless a stated part is around."""
        if all(self.kinds[k] != "stated" for k in out):
            self.whole.update(out)

    def parse(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = TAG.search(page, at)
            if m is None:
                self.add(page[at:])
                break
            if m.start() > at:
                self.add(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self.close(name)
                continue
            if name in SPACED:
                self.add(" ")
            if name in BLOCKS:
                self.close_before(name)
                self.end_block()
            if name in VOID:
                continue
            if name in RAW and not m[0].endswith("/>"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else n
                continue
            self.open(name, m[3] or "", m[0].endswith("/>"))

    def close(self, name: str) -> None:
        i = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name), None)
        if i is not None:
            self.pop_to(i)
        elif name in BLOCKS:
            self.end_block()

    def close_before(self, name: str) -> None:
        """A block ends an open paragraph, and an item the one before."""
        closes = ("p",) if name != "li" else ("p", "li")
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in closes:
                self.pop_to(i)
                break
            if self.stack[i][0] in BLOCKS:
                break

    def open(self, name: str, attributes: str, closed: bool) -> None:
        out, article = self.stack[-1][1:3] if self.stack else ((), False)
        main, named = name in ("article", "main"), False
        for a in MARKS.finditer(attributes) if name not in ("html", "body") else ():
            value = a[2] or a[3] or a[4] or ""
            names = [value] if a[1].lower() == "id" else value.split()
            main = main or a[1].lower() == "role" and value.lower() == "main"
            named = named or any(declared(x, article or name in ("article", "main")) for x in names)
        stated = name in ASIDE and not (name == "header" and article)
        if main and not named:
            self.holds_article(out)
        elif name == "h1":
            self.holds_article(tuple(k for k in out if self.kinds[k] == "form"))
        if stated or named:
            k = len(self.kinds)
            self.kinds[k] = "form" if name == "form" else "stated" if stated or COMMENTS.search(attributes) else "named"
            out = (*out, k)
        if not closed:
            self.stack.append((name, out, article or main))

    def texts(self) -> list[str]:
        out = []
        for block in self.blocks:
            text = "".join(t for t, around in block if self.whole.issuperset(around))
            if text := " ".join(html.unescape(text).split()):
                out.append(text)
        return out


def blocks_of(page: str) -> list[str]:
    """Blocks of the main text, white space collapsed, in page order."""
    return Page(page).texts()


def token_names(blocks: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit names of a page's tokens."""
    out = []
    for block in blocks:
        for token in block.split(" "):
            if (x := known.get(token)) is None:
                x = known[token] = xxhash.xxh3_64_intdigest(token.encode())
            out.append(x)
    return np.array(out, np.uint64)


def suffix_names(x: np.ndarray, least: int) -> np.ndarray:
    """Names of the suffixes by their first `least` tokens: prefix doubling, stopped at the threshold."""
    h = 1
    while h < least:
        step = min(h, least - h)
        x = mix(x[:-step] * np.uint64(0x9E3779B97F4A7C15) + x[step:] + np.uint64(step))
        h += step
    return x


class Stream:
    """The token streams of pages, one after the other, and the names of their strings of `least` tokens."""

    def __init__(self, pages: list[list[str]], least: int):
        known: dict[str, int] = {}
        tokens = [token_names(p, known) for p in pages]
        self.least, self.lengths = least, np.array([len(t) for t in tokens], np.int64)
        # A page ends in `least` tokens of its own, so no string runs over it.
        ends = mix(np.arange(1, len(pages) * least + 1, dtype=np.uint64) + np.uint64(1 << 60)).reshape(-1, least)
        self.names = suffix_names(np.concatenate([x for t, e in zip(tokens, ends, strict=True) for x in (t, e)] + [ends[0]]), least)
        self.starts = np.cumsum(self.lengths + least) - self.lengths - least
        self.page = np.repeat(np.arange(len(pages)), self.lengths + least)
        self.names = self.names[: len(self.page)]
        self.inside = np.arange(len(self.page)) - self.starts[self.page] <= (self.lengths - least)[self.page]

    def covered(self, marked: np.ndarray) -> np.ndarray:
        """Tokens that lie in a string whose start is marked."""
        change = np.zeros(len(marked) + self.least, np.int32)
        at = np.flatnonzero(marked)
        np.add.at(change, at, 1)
        np.add.at(change, at + self.least, -1)
        return np.cumsum(change[: len(marked)]) > 0

    def repeated(self, bar: float) -> np.ndarray:
        """Sorted names of the strings that are on so many of these pages."""
        at = np.flatnonzero(self.inside)
        order = at[np.lexsort((self.page[at], self.names[at]))]  # the suffix array, as far as `least` tokens tell
        name, page = self.names[order], self.page[order]
        new = np.append(True, name[1:] != name[:-1])
        each = np.append(True, (name[1:] != name[:-1]) | (page[1:] != page[:-1]))
        if not len(order):
            return np.empty(0, np.uint64)
        return name[new][np.bincount(np.cumsum(new) - 1, weights=each) >= bar - 1e-9]

    def pages_with(self, names: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """On how many of these pages (among those marked) each of the sorted names is."""
        place = find(names, self.names)
        at = np.flatnonzero(self.inside & (place >= 0) & (True if among is None else among[self.page]))
        pairs = np.unique(place[at].astype(np.int64) * len(self.lengths) + self.page[at])
        return np.bincount(pairs // max(1, len(self.lengths)), minlength=len(names))

    def own(self, names: np.ndarray) -> np.ndarray:
        """Pages a quarter of whose tokens lie in none of these strings."""
        marked = self.inside & (find(names, self.names) >= 0)
        covered = np.bincount(self.page, weights=self.covered(marked), minlength=len(self.lengths))
        return covered <= (1 - OWN) * self.lengths

    def common(self, share: float, few: int) -> np.ndarray:
        """Names of strings that are boilerplate, where these pages are a whole host."""
        names = self.repeated(max(few, share * len(self.lengths)))
        return names[self.pages_with(names, self.own(names)) >= 2] if len(names) else names

    def gone(self, names: np.ndarray) -> list[np.ndarray]:
        """For each page, which of its tokens lie in strings of these (sorted) names."""
        covered = self.covered(self.inside & (find(names, self.names) >= 0))
        return [covered[a : a + n] for a, n in zip(self.starts, self.lengths, strict=True)]


def unique_words(block: list[str], gone: np.ndarray, least: int) -> list[str]:
    """What stays of a block: nothing if all of it is covered, else all but covered runs of at least `least` words."""
    if gone.all():
        return []
    left, at = [], 0
    for covered, run in itertools.groupby(gone.tolist()):
        n = len(list(run))
        if not covered or n < least:
            left += block[at : at + n]
        at += n
    return left


def to_bundle(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return out.getvalue().to_pybytes()


def groups_of(t: pa.Table) -> Iterator[tuple[str, int, int, pa.Table]]:
    """Host, part, parts and the pages of each group in a bucket of bundles."""
    t = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in t.column("bundle").to_pylist()])
    t = t.sort_by([("host", "ascending"), ("part", "ascending"), ("page_id", "ascending")])
    keys = list(zip(*(t.column(c).to_pylist() for c in ("host", "part", "parts")), strict=True))
    a = 0
    for key, rows in itertools.groupby(keys):
        n = len(list(rows))
        yield *key, t.slice(a, n)
        a += n


def pages_in(rows: pa.Table) -> list[list[str]]:
    return [x.split("\n") if x else [] for x in rows.column("blocks").to_pylist()]


def extract(pages: DataFrame, least: int = 6, share: float = 0.6, few: int = 3, group: int = 512) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    host = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)
    host = F.lower(F.coalesce(host, F.lit("")))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host)
    # Hosts of several groups: at most one for `group` pages. Their list goes to all tasks below a bound; beyond it,
    # it is copied to a few salts, so that the pages of one host meet it in several tasks.
    counts = rows.groupBy("host").agg(F.count("*").alias("pages"))
    counts = staged(counts, "host-pages")
    large = counts.select("host", F.ceil(F.col("pages") / group).cast("int").alias("parts")).where("parts > 1")
    salts = 1 if large.count() <= BROADCAST_HOSTS else 16
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = F.broadcast(salted) if salts == 1 else salted
    buckets = max(4 * shuffle_width(pages.sparkSession), (counts.agg(F.sum("pages")).first()[0] or 0) // (4 * group))
    bucket = lambda part: F.pmod(F.xxhash64("host", part), F.lit(buckets))

    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("url", "page_id"), F.col("parts")).cast("int"))
    rows = rows.select("page_id", "url", "host", "part", "parts", bucket("part").alias("bucket"), "html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the pages, in compressed bundles by bucket: text makes up all of the shuffle."""
        for b in pieces(batches, 6):
            blocks = pa.array(["\n".join(blocks_of(x)) if x else "" for x in b.column(6).to_pylist()], pa.string())
            cut = pa.RecordBatch.from_arrays([*b.columns[:5], blocks], names=["page_id", "url", "host", "part", "parts", "blocks"])
            bucket = b.column(5).to_numpy()
            found = np.unique(bucket)
            bundles = [to_bundle(cut.take(pa.array(np.flatnonzero(bucket == k)))) for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(bundles, pa.binary())], names=["bucket", "bundle"])

    cut = rows.mapInArrow(parse, "bucket long, bundle binary")
    names_of = "host string, parts int, name long, pages long"

    def rows_of(found: list[tuple[str, int, np.ndarray, np.ndarray]]) -> pa.Table:
        """host, parts, name, pages of each name of each (host, parts, names, pages)."""
        sizes = [len(x) for _, _, x, _ in found]
        flat = lambda k, kind: pa.array(np.concatenate([np.asarray(f[k]).astype(np.int64, casting="unsafe") for f in found]) if found else [], kind)
        each = lambda k, kind: pa.array([f[k] for f, n in zip(found, sizes, strict=True) for _ in range(n)], kind)
        return pa.table({"host": each(0, pa.string()), "parts": each(1, pa.int32()), "name": flat(2, pa.int64()), "pages": flat(3, pa.int64())})

    def names_by_host(t: pa.Table) -> dict[str, np.ndarray]:
        out: dict[str, list[int]] = {}
        for host, name in zip(t.column("host").to_pylist(), t.column("name").to_pylist(), strict=True):
            out.setdefault(host, []).append(name)
        return {h: np.unique(np.array(x, np.int64).view(np.uint64)) for h, x in out.items()}

    @trimmed
    def ask(t: pa.Table) -> pa.Table:
        """The boilerplate of hosts that lie here whole, and the candidates of others."""
        out = []
        for host, _, parts, rows in groups_of(t):
            s = Stream(pages_in(rows), least)
            names = s.common(share, few) if parts == 1 else s.repeated(share * len(s.lengths))
            out.append((host, parts, names.view(np.int64), np.zeros(len(names), np.int64)))
        return rows_of(out)

    def counting(own: bool):
        @trimmed
        def count(t: pa.Table, named: pa.Table) -> pa.Table:
            """On how many pages of a group each name of its host is; own: of those with text to themselves."""
            wanted, out = names_by_host(named), []
            for host, _, parts, rows in groups_of(t) if len(t) and wanted else ():
                if host in wanted:
                    s, names = Stream(pages_in(rows), least), wanted[host]
                    out.append((host, parts, names.view(np.int64), s.pages_with(names, s.own(names) if own else None)))
            return rows_of(out)

        return count

    def dealt(names: DataFrame) -> DataFrame:
        """Names of a host for all its groups."""
        each = names.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return each.select(bucket("part").alias("bucket"), "host", "name")

    def summed(names: DataFrame, own: bool) -> DataFrame:
        """Pages of the whole host by name, from the groups' counts."""
        counted = cut.groupBy("bucket").cogroup(dealt(names).groupBy("bucket")).applyInArrow(counting(own), names_of)
        return counted.groupBy("host", "parts", "name").agg(F.sum("pages").alias("n"))

    named = cut.groupBy("bucket").applyInArrow(ask, names_of)
    if not large.isEmpty():
        candidates = named.where("parts > 1").select("host", "parts", "name").distinct()
        often = summed(candidates, False).join(counts, "host")
        often = often.where(F.col("n") >= F.greatest(F.lit(float(few)), share * F.col("pages")) - 1e-9).select("host", "parts", "name")
        decided = summed(often, True).where("n >= 2").select("host", "parts", "name")
        named = named.where("parts = 1").select("host", "parts", "name").unionByName(decided)
    named = dealt(named)

    @trimmed
    def clean(t: pa.Table, named: pa.Table) -> pa.Table:
        of_host = names_by_host(named)
        ids, urls, out = [], [], []
        for host, _, _, rows in groups_of(t) if len(t) else ():
            ids.append(rows.column("page_id"))
            urls.append(rows.column("url"))
            texts = rows.column("blocks").to_pylist()
            if host not in of_host:
                out += [x.replace("\n", "\n\n") for x in texts]
                continue
            pages = pages_in(rows)
            for page, gone in zip(pages, Stream(pages, least).gone(of_host[host]), strict=True):
                at, kept = 0, []
                for block in (x.split(" ") for x in page):
                    if left := unique_words(block, gone[at : at + len(block)], least):
                        kept.append(" ".join(left))
                    at += len(block)
                out.append("\n\n".join(kept))
        flat = lambda parts, kind: pa.array([x for p in parts for x in p.to_pylist()], kind)
        texts, sizes = pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())
        return pa.table({"page_id": flat(ids, pa.int64()), "url": flat(urls, pa.string()), "text": texts, "n_chars": sizes})

    result = "page_id long, url string, text string, n_chars long"
    return cut.groupBy("bucket").cogroup(named.groupBy("bucket")).applyInArrow(clean, result)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
